"""Anchor spans of a target's phrases in a source's text.

Only the first place of a phrase can ever be chosen: all places share text, words
and validity, and the score falls with the place.  The choice is therefore a sort
and a cut within the pair's own row, without a shuffle: the best span of each
text, then the best ``limit`` spans, in the order of their places.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions import text as X

#: What a phrase's origin is worth.
VARIANTS = {"entity": 1.0, "exact": 0.95, "partial": 0.8, "brand": 0.75, "tag": 0.7, "generic": 0.6}
ANCHORS = "array<struct<text:string,start:int,end:int,variant:string>>"


def _phrase(text: Column, variant: Column | str) -> Column:
    return F.struct(X.strip(text).alias("phrase"), (F.lit(variant) if isinstance(variant, str) else variant).alias("variant"))


def _valid(every: Column) -> Column:
    return F.array_distinct(F.filter(every, lambda p: p["phrase"].isNotNull() & (p["phrase"] != "") & X.valid_phrase(p["phrase"], p["variant"])))


def entity_kind(kind: Column) -> Column:
    """The variant of the one phrase that depends on the pair, its first shared entity, by the target's type of it."""
    return F.when(kind.isin(list(VARIANTS)), kind).otherwise("entity")


def page_phrases(title: Column, body: Column, head_terms: Column, brand: Column, tags: Column) -> Column:
    """Distinct (phrase, variant) by which a target may be linked from anywhere: title, its first and last words,
    head terms, brand, and tags that the target's title or text holds."""
    name = X.strip(title)
    held = F.filter(tags, lambda g: (X.strip(g) != "") & (F.contains(F.lower(title), F.lower(X.strip(g))) | F.contains(F.lower(body), F.lower(X.strip(g)))))
    fixed = F.array(_phrase(name, "exact"), _phrase(X.head_terms(name), "partial"), _phrase(X.tail_terms(name), "partial"), _phrase(brand, "brand"))
    return _valid(F.concat(fixed, F.transform(head_terms, lambda h: _phrase(h, "partial")), F.transform(held, lambda g: _phrase(F.translate(X.strip(g), "-", " "), "tag"))))


def variant_weight(variant: Column) -> Column:
    out = F.lit(0.5)
    for k, w in VARIANTS.items():
        out = F.when(variant == k, w).otherwise(out)
    return out


def anchor_score(variant: Column, start: Column, length: Column, n_words: Column) -> Column:
    return variant_weight(variant) * (0.7 + 0.2 * (1 - start / F.greatest(length, F.lit(1))) + 0.1 * F.greatest(F.lit(0.0), 1 - F.abs(n_words - 4) / 10))


#: Variants whose phrases and anchors are short.
SHORT = ("entity", "brand", "tag")


def named_phrases(entities: Column) -> dict[str, Column]:
    """A source's entities as phrases: in lower case, their lengths, and whether they are valid as short and as other ones."""
    names = F.transform(entities, lambda e: X.strip(e["name"]))
    valid = lambda variant: F.transform(names, lambda x: (x != "") & X.valid_phrase(x, F.lit(variant)))
    return {"n_low": F.transform(names, F.lower), "n_len": F.transform(names, F.length), "n_short": valid("entity"), "n_other": valid("generic")}


def target_phrases() -> dict[str, Column]:
    """The phrases of a target, in lower case, their lengths and variants, and the variants of its entities."""
    own = page_phrases(F.col("title"), F.col("text"), F.col("head_terms"), F.col("brand"), F.col("tags"))
    return {"p_low": F.transform(own, lambda p: F.lower(p["phrase"])), "p_len": F.transform(own, lambda p: F.length(p["phrase"])), "p_variant": F.transform(own, lambda p: p["variant"]), "e_variant": F.transform("entities", lambda e: entity_kind(e["type"]))}


def places(hits: Column, length: Column) -> Column:
    """Valid spans of ``hits`` (text, start, end, variant: the first place of a phrase in a text of ``length``), with their scores."""

    def span(p: Column) -> Column:
        return F.struct(
            X.normal_term(p["text"]).alias("norm"), (-variant_weight(p["variant"])).alias("w"), p["start"].alias("start"), p["end"].alias("end"), p["text"].alias("text"),
            p["variant"].alias("variant"), anchor_score(p["variant"], p["start"], length, F.size(X.words(p["text"]))).alias("score"))

    return F.filter(F.transform(hits, span), lambda x: X.valid_anchor(x["text"], x["variant"]))


def select_anchors(pairs: DataFrame, spans: str, limit: int, out: str = "anchors") -> DataFrame:
    """Add ``out``: of each text the span of the best variant, of these the ``limit`` best
    by score (then place), in the order of their places.  No spans give an empty array."""
    by_text = F.array_sort(spans)
    df = pairs.withColumn(out, by_text)
    df = df.withColumn(out, F.filter(F.col(out), lambda x, i: (i == 0) | (F.get(F.col(out), i - 1)["norm"] != x["norm"])))
    ranked = F.array_sort(F.transform(out, lambda x: F.struct((-F.round(x["score"], 9)).alias("by"), x["start"].alias("start"), x["end"].alias("end"), x["norm"].alias("norm"), x["text"].alias("text"), x["variant"].alias("variant"))))
    df = df.withColumn(out, F.slice(ranked, 1, limit))
    df = df.withColumn(out, F.array_sort(F.transform(out, lambda x, i: F.struct(x["start"].alias("start"), i.alias("i"), x["end"].alias("end"), x["text"].alias("text"), x["variant"].alias("variant")))))
    return df.withColumn(out, F.transform(out, lambda x: F.struct(x["text"].alias("text"), x["start"].alias("start"), x["end"].alias("end"), x["variant"].alias("variant"))).cast(ANCHORS))


def with_anchors(pairs: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Pairs with ``hits`` and ``length`` (as :func:`linkspark.operators.blocks.best_pairs` finds them) with their chosen anchors instead;
    those without one leave."""
    spans = pairs.withColumn("spans", places(F.col("hits"), F.col("length"))).drop("hits", "length").where(F.size("spans") > 0)
    return select_anchors(spans, "spans", int(config["max_anchors_per_target"])).drop("spans").where(F.size("anchors") > 0)
