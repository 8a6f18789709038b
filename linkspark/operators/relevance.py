"""Relevance of target pages for source pages: gates, factors, features, scores and reasons of pairs.

Pairs come from :mod:`linkspark.operators.blocks`, which also brings page attributes to the best
of each source; those that have an anchor join them after.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions import scores as S
from linkspark.functions import urls as U
from linkspark.operators.anchors import with_anchors
from linkspark.operators.blocks import best_pairs

#: Columns of a page that chosen pairs carry; its texts are joined again where they are needed.
ATTRIBUTES = (
    "page_id url title lang tags tag_set type published canonical noindex nofollow is_login is_cart is_redirect is_paginated_duplicate blocked is_pillar is_hub is_money_page is_conversion_page is_reference has_schema "
    "status_code outbound_links taxonomy head_terms brand parent_id authority_score inlinks click_depth content_score entities body_len n_words").split()


def with_pages(pairs: DataFrame, sources: DataFrame, corpus: DataFrame) -> DataFrame:
    """Pairs with structs ``s`` and ``t`` of both pages' attributes, and ``first_entity``: the first of the
    source's entities that the target has, with the target's type."""
    s = sources.select(F.col("page_id").alias("src"), F.struct(*ATTRIBUTES).alias("s"))
    t = corpus.select(F.col("page_id").alias("tgt"), F.struct(*ATTRIBUTES).alias("t"))
    both = pairs.join(t, "tgt").join(s, "src")
    name = F.get(F.col("s.entities"), F.col("first_pos"))["name"]
    theirs = F.filter("t.entities", lambda e: F.lower(e["name"]) == F.lower(name))
    return both.withColumn("first_entity", F.when(F.col("first_pos") >= 0, F.struct(name.alias("name"), F.get(theirs, F.size(theirs) - 1)["type"].alias("type"))))


def s(k: str) -> Column:
    return F.col(f"s.{k}")


def t(k: str) -> Column:
    return F.col(f"t.{k}")


def business_filter() -> Column:
    same = s("canonical").isNotNull() & t("canonical").isNotNull() & (s("canonical") == t("canonical"))
    return (s("url") != t("url")) & ~t("noindex") & ~t("nofollow") & ~same & ~t("is_login") & ~t("is_cart") & (t("status_code") < 300) & ~U.tracking_only(t("url"))


def guardrails(config: dict[str, Any]) -> Column:
    canonical = t("canonical").isNull() | (t("canonical") == t("url"))
    other = s("lang").isNotNull() & t("lang").isNotNull() & (s("lang") != t("lang"))
    shared = F.arrays_overlap(s("tag_set"), t("tag_set"))
    return (
        (s("url") != t("url")) & ~t("noindex") & ~t("nofollow") & canonical & ~t("is_redirect") & (t("status_code") < 300) & ~t("is_paginated_duplicate")
        & ~t("url").contains("login") & ~t("url").contains("cart") & ~t("blocked") & (~other | shared | F.lit(bool(config["allow_cross_language"]))))


def language_factor() -> Column:
    return F.when(s("lang").isNull() | t("lang").isNull(), 0.7).when(s("lang") == t("lang"), 1.0).when(F.arrays_overlap(s("tag_set"), t("tag_set")), 0.6).otherwise(0.1)


def review_factor() -> Column:
    title = F.lower(t("title"))
    guide = t("type").isin("category", "review") & (title.contains("best") | title.contains("top") | title.contains("guide"))
    return F.when(s("type") != "review", 1.0).when(guide, 1.2).when(t("type") == "product", 1.1).otherwise(1.0)


def recall_score() -> Column:
    parts = 0.35 * F.least(F.col("title_bm25") / 8, F.lit(1.0)) + 0.35 * F.least(F.col("body_bm25") / 12, F.lit(1.0)) + 0.2 * F.col("cosine") + 0.25 * F.col("entity") + 0.15 * F.col("tag")
    return parts * language_factor() * review_factor()


def candidates(sources: DataFrame, corpus: DataFrame, config: dict[str, Any], gated: bool = True, own: Sequence[str] = ATTRIBUTES, theirs: Sequence[str] = ATTRIBUTES, entity: bool = True) -> DataFrame:
    """The ``max_candidates`` best targets of each source by recall score (above 0.05), ties to
    nine places by page_id; ``rank`` counts from 1.  ``gated`` applies :func:`business_filter` before.  Structs ``s`` and ``t`` have those
    attributes of both pages that are asked for, and ``first_entity`` is that of :func:`with_pages`; no join brings them."""
    return best_pairs(sources, corpus, config["max_candidates"], gated=gated, own=own, theirs=theirs, entity=entity)


def linkable(sources: DataFrame, corpus: DataFrame, config: dict[str, Any]) -> DataFrame:
    """Those of :func:`candidates` that have an anchor, with ``anchors``; attributes join these alone."""
    return with_pages(with_anchors(best_pairs(sources, corpus, config["max_candidates"], spans=True), config), sources, corpus)


def features(config: dict[str, Any], as_of: str) -> dict[str, Column]:
    """The fourteen features of a candidate pair, in their order."""
    lang = F.when(s("lang").isNotNull() & t("lang").isNotNull(), F.when(s("lang") == t("lang"), 1.0).otherwise(0.3)).otherwise(0.7)
    authority = F.when(F.coalesce(t("authority_score"), F.lit(0.0)) != 0, t("authority_score")).otherwise(F.coalesce(t("inlinks"), F.lit(0.0)) / float(config["max_inlinks"]))
    content = F.coalesce(t("content_score"), F.lit(0.0))
    content = F.when(t("has_schema"), F.greatest(content, F.lit(0.6))).otherwise(content)
    depth = 1 - (F.coalesce(t("click_depth"), F.lit(3.0)) - 1) / float(config["max_click_depth"])
    asked = F.coalesce(s("published"), F.lit(as_of).cast("timestamp"))
    return {
        "f_title_bm25": S.scaled(F.col("title_bm25"), config["title_bm25_norm"]), "f_body_bm25": S.scaled(F.col("body_bm25"), config["body_bm25_norm"]), "f_semantic": S.clamp(F.col("cosine")),
        "f_entity_overlap": F.col("entity"), "f_tag_overlap": F.col("tag"), "f_taxonomy_distance": S.overlap(s("taxonomy"), t("taxonomy")),
        "f_authority": S.clamp(authority), "f_click_depth": S.clamp(depth), "f_conversion_intent": F.when(t("type").isin("review", "category", "product"), 1.0).otherwise(0.3),
        "f_duplicate_risk": F.when(F.array_contains(s("outbound_links"), t("url")), 1.0).otherwise(0.0), "f_lang_match": lang, "f_lang_mismatch": 1 - lang,
        "f_quality": S.clamp(0.6 * F.least(t("body_len") / F.lit(float(config["quality_wordcount_norm"])), F.lit(1.0)) + 0.4 * content), "f_freshness": S.freshness(asked, t("published"), config["freshness_half_life_days"]),
    }


def linear_score(config: dict[str, Any], names: list[str]) -> Column:
    plus = [F.col(k) * float(config["weights"].get(k, 0.0)) for k in names]
    minus = [F.col(k) * float(config["penalties"].get(k, 0.0)) for k in names]
    total = F.lit(0.0)
    for x in plus:
        total = total + x
    for x in minus:
        total = total - x
    return S.logistic(total)


#: What each feature is called in a reason.
REASONS = {
    "f_title_bm25": "strong title match", "f_body_bm25": "content overlap", "f_semantic": "semantic similarity", "f_entity_overlap": "shared entities", "f_tag_overlap": "tag overlap",
    "f_authority": "authoritative target", "f_click_depth": "shallow depth", "f_conversion_intent": "conversion intent", "f_freshness": "recent update", "f_lang_match": "language match", "f_quality": "high-quality target",
}


def reason_text(config: dict[str, Any], names: list[str], most: int = 2) -> Column:
    """The ``most`` features that add most, in words; a feature without words takes its place silently."""
    rows = [F.struct((F.col(k) * float(config["weights"].get(k, 0.0))).alias("v"), F.lit(k).alias("k"), F.col(k).alias("f"), F.lit(REASONS.get(k)).cast("string").alias("said")) for k in names if config["weights"].get(k, 0.0) > 0]
    top = F.slice(F.reverse(F.array_sort(F.filter(F.array(*rows), lambda r: r["v"] > 0))), 1, most)
    said = F.filter(top, lambda r: r["said"].isNotNull())
    grade = lambda f: F.when(f >= 0.85, "excellent").when(f >= 0.6, "strong").otherwise("good")
    return F.array_join(F.transform(said, lambda r: F.concat_ws(" ", grade(r["f"]), r["said"])), "; ")


def scored(pairs: DataFrame, config: dict[str, Any], as_of: str) -> DataFrame:
    """Candidate pairs with their features, score and reason."""
    made = features(config, as_of)
    return pairs.withColumns(made).withColumn("score", linear_score(config, list(made))).withColumn("reason", reason_text(config, list(made)))


def risk_flags(config: dict[str, Any]) -> Column:
    """``lang_mismatch``, ``thin_target`` and ``dup_anchor``, those that hold."""
    lang = F.when(s("lang").isNotNull() & t("lang").isNotNull() & (s("lang") != t("lang")), "lang_mismatch")
    thin = F.when((t("type") == "product") & (t("body_len") < config["product_wordcount_min"]), "thin_target")
    dup = F.when(F.array_contains(s("outbound_links"), t("url")), "dup_anchor")
    return F.array_compact(F.array(lang, thin, dup))


def placement() -> Column:
    return F.when(t("is_pillar") | t("type").isin("category", "pillar"), "intro").when(t("is_conversion_page"), "body").when(t("is_reference"), "conclusion").otherwise("body")


def role() -> Column:
    """parent, sibling, money or other, the first that holds."""
    prefix = (F.size(t("taxonomy")) > 0) & (F.slice(s("taxonomy"), F.lit(1), F.greatest(F.size(t("taxonomy")), F.lit(1))) == t("taxonomy"))
    kin = F.coalesce((s("parent_id") != "") & (s("parent_id") == t("parent_id")), F.lit(False)) | (F.arrays_overlap(s("tags"), t("tags")) & (s("type") == t("type")))
    return F.when(t("is_pillar") | t("is_hub") | prefix, "parent").when(kin, "sibling").when(t("is_money_page"), "money").otherwise("other")
