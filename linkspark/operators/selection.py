"""Greedy choice of each source's links under its budget, and diagnostics of the result."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions.scores import entropy_share, link_budget

ITEM = "struct<by:double,rank:int,tgt:bigint,url:string,reason:string,score:double,anchors:array<struct<text:string,start:int,end:int,variant:string>>,placement:string,flags:array<string>,role:string>"


def _lists(pairs: DataFrame, config: dict[str, Any]) -> DataFrame:
    """(src, items, budget): each source's pairs by falling score, ties to nine places by candidate rank.
    A source has at most ``max_candidates`` pairs, so its list stays short."""
    item = F.struct(
        (-F.round("score", 9)).alias("by"), F.col("rank").cast("int").alias("rank"), "tgt", F.col("t.url").alias("url"), "reason", "score", "anchors", "placement", F.col("risk_flags").alias("flags"), "role").cast(ITEM)
    budget = link_budget(F.col("s.n_words"), int(config["base_links_per_page"]), int(config["max_links_per_page"]))
    return pairs.groupBy("src").agg(F.array_sort(F.collect_list(item)).alias("items"), F.first(budget).alias("budget"))


def _texts(x: Column) -> Column:
    return F.transform(x["anchors"], lambda a: F.lower(a["text"]))


def _links(taken: DataFrame) -> DataFrame:
    return taken.select("src", F.posexplode("taken").alias("at", "x")).select(
        "src", (F.col("at") + 1).alias("place"), F.col("x.tgt").alias("tgt"), F.col("x.url").alias("target_url"), F.col("x.reason").alias("reason"), F.col("x.score").alias("score"), F.col("x.anchors").alias("anchors"),
        F.col("x.placement").alias("placement_hint"), F.lit("follow").alias("rel"), F.col("x.flags").alias("risk_flags"), F.col("x.role").alias("role"))


def greedy_links(pairs: DataFrame, config: dict[str, Any]) -> DataFrame:
    """(src, place, tgt, target_url, reason, score, anchors, placement_hint, rel, risk_flags, role).

    By falling score a pair is taken unless its target or one of
    its anchor texts is used already, until the source's budget is full.  The fold is one expression."""
    lists = _lists(pairs, config)
    start = F.struct(F.array().cast(f"array<{ITEM}>").alias("taken"), F.array().cast("array<string>").alias("texts"), F.array().cast("array<string>").alias("urls"))

    def step(acc, x):
        own = _texts(x)
        fits = (F.size(acc["taken"]) < F.col("budget")) & ~F.array_contains(acc["urls"], x["url"]) & ~F.arrays_overlap(acc["texts"], own)
        more = F.struct(F.array_append(acc["taken"], x).alias("taken"), F.concat(acc["texts"], own).alias("texts"), F.array_append(acc["urls"], x["url"]).alias("urls"))
        return F.when(fits, more).otherwise(acc)

    return _links(lists.select("src", F.aggregate("items", start, step)["taken"].alias("taken")))


def enforce_roles(pairs: DataFrame, chosen: DataFrame, config: dict[str, Any], roles: tuple[str, ...] = ("parent", "sibling")) -> DataFrame:
    """Links like those of :func:`greedy_links` of ``chosen(src, tgt, place)`` pairs, completed by ``roles`` in turn.

    Where no chosen link of a source has the role, its best pair of that role with an unused target and
    unused anchor texts is added, or takes the place of the weakest link if the budget is full and that one scores less.
    After :func:`greedy_links` this changes nothing; it serves links that were chosen elsewhere.
    Chosen pairs that are none of ``pairs`` are left out; a source without pairs has no links."""
    picked = _lists(pairs.join(chosen.select("src", "tgt").distinct(), ["src", "tgt"]), config).select("src", F.col("items").alias("taken"))
    order = chosen.groupBy("src").agg(F.map_from_entries(F.collect_set(F.struct("tgt", "place"))).alias("order"))
    df = _lists(pairs, config).join(picked, "src", "left").join(order, "src", "left")
    placed = F.transform(F.array_sort(F.transform("taken", lambda x: F.struct(F.element_at("order", x["tgt"]).alias("p"), x.alias("x")))), lambda y: y["x"])
    df = df.select("src", "items", "budget", F.coalesce(placed, F.array().cast(f"array<{ITEM}>")).alias("taken"))
    for role in roles:
        used, urls = F.flatten(F.transform("taken", _texts)), F.transform("taken", lambda x: x["url"])
        df = df.withColumns({"used": used, "urls": urls, "scores": F.transform("taken", lambda x: x["score"])})
        df = df.withColumn("fit", F.get(F.filter("items", lambda x: (x["role"] == role) & ~F.array_contains(F.col("urls"), x["url"]) & ~F.arrays_overlap(F.col("used"), _texts(x))), F.lit(0)))  # noqa: B023
        weakest = F.array_position("scores", F.array_min("scores")) - 1
        same = (F.col("budget") <= 0) | F.exists("taken", lambda x: x["role"] == role) | F.col("fit").isNull()  # noqa: B023
        swapped = F.transform("taken", lambda x, i: F.when(i == weakest, F.col("fit")).otherwise(x))  # noqa: B023
        df = df.withColumn("taken", F.when(same, F.col("taken")).when(F.size("taken") < F.col("budget"), F.array_append("taken", F.col("fit"))).when(F.array_min("scores") < F.col("fit.score"), swapped).otherwise(F.col("taken")))
    return _links(df)


def inbound_counts(links: DataFrame, corpus: DataFrame) -> DataFrame:
    """(page_id, inbound) of every corpus page, 0 without links."""
    count = links.groupBy(F.col("tgt").alias("page_id")).agg(F.count("*").alias("inbound"))
    return corpus.select("page_id").join(count, "page_id", "left").select("page_id", F.coalesce("inbound", F.lit(0)).alias("inbound"))


def link_metrics(links: DataFrame, evaluated: DataFrame, sources: DataFrame, corpus: DataFrame) -> DataFrame:
    """One row of diagnostics of a batch; ``evaluated(src, tgt, score)`` are the pairs that stood for choice."""
    pages = sources.agg(F.count("*").alias("pages"))
    linked = links.agg(
        F.count_distinct("src").alias("linked"), F.count("*").alias("n"), F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score_selected"),
        F.coalesce(F.avg(F.array_contains("risk_flags", "lang_mismatch").cast("double")), F.lit(0.0)).alias("language_mismatch_rate"))
    repeats = links.groupBy("src").agg((F.count("*") - F.count_distinct("tgt")).alias("r")).agg(F.coalesce(F.sum("r"), F.lit(0)).alias("repeats"))
    rejected = evaluated.join(links.select("src", "tgt"), ["src", "tgt"], "left_anti").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("mean_score_rejected"))
    depth = F.coalesce("click_depth", F.lit(3.0))
    shape = inbound_counts(links, corpus).join(corpus.select("page_id", "click_depth"), "page_id").agg(
        F.coalesce(F.avg((F.col("inbound") == 0).cast("double")), F.lit(0.0)).alias("orphan_rate"),
        F.coalesce(F.avg(F.when(F.col("inbound") > 0, F.greatest(F.lit(1.0), depth - 0.5 * F.col("inbound"))).otherwise(depth)), F.lit(0.0)).alias("avg_click_depth_after"))
    kinds = variant_counts(links).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("variant", "n")))).alias("anchor_variant_counts"))
    row = pages
    for one in (linked, repeats, rejected, shape, kinds):  # one row each
        row = row.crossJoin(F.broadcast(one))
    share = lambda a: F.when(F.col("pages") > 0, F.col(a) / F.col("pages")).otherwise(0.0)
    return row.select(
        share("linked").alias("coverage"), "orphan_rate", "avg_click_depth_after", entropy_share(F.transform(F.map_values("anchor_variant_counts"), lambda x: x.cast("double"))).alias("anchor_diversity_index"),
        share("repeats").alias("dup_target_rate"), "mean_score_selected", "mean_score_rejected", "language_mismatch_rate", "anchor_variant_counts")


def variant_counts(links: DataFrame) -> DataFrame:
    return links.select(F.explode("anchors").alias("a")).groupBy(F.col("a.variant").alias("variant")).agg(F.count("*").alias("n"))
