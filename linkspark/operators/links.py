"""The link table: slugs, imports, search and history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.functions import text as X
from linkspark.functions import urls as U


def slugged(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows with ``raw_slug`` and ``slug`` of their url; both empty for a root, null for a null url."""
    return urls.withColumns({"raw_slug": U.raw_slug(F.col(url_col)), "slug": U.slug(F.col(url_col))})


def same_host(url: Column, base_host: Column) -> Column:
    """Relative urls and those of the base's host."""
    h = U.host(url)
    return h.isNull() | (h == F.lower(base_host))


def slug_map(links: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., slug, url): of the links that share a slug the one of the largest id."""
    keys = [*(by or []), "slug"]
    return links.where("slug is not null").groupBy(*keys).agg(F.max_by("url", "id").alias("url"))


def import_links(urls: DataFrame, base_url: str | None) -> DataFrame:
    """(base_url, url, raw_slug, slug) of a sitemap's urls on the base's host.  Without a base it
    is the first absolute url's origin; none at all is an error.  Repeats stay, as imports count them."""
    if not base_url:
        first = urls.select(U.origin(F.col("url")).alias("o"), "pos").where("o is not null").orderBy("pos").limit(1).collect()
        if not first:
            raise ValueError("no base url is given or can be inferred")
        base_url = first[0]["o"]
    kept = urls.where(same_host(F.col("url"), U.host(F.lit(base_url))))
    return slugged(kept.select(F.lit(base_url).alias("base_url"), "url"))


def upsert_links(existing: DataFrame, incoming: DataFrame, keys: list[str], replaced: list[str], kept: list[str], order: str) -> DataFrame:
    """Existing rows united with incoming ones by ``keys``: of incoming repeats the last by
    ``order`` counts, its ``replaced`` columns win, and ``kept`` columns stay as they were first.
    One aggregation: both sides are tagged, united and combined by key, so a key's rows never meet in a list."""
    new = incoming.select(*keys, *replaced, *kept, F.struct(F.lit(1).alias("side"), F.col(order).alias("at")).alias("o"))
    old = existing.select(*keys, *replaced, *kept, F.struct(F.lit(0).alias("side"), F.col(order).alias("at")).alias("o"))
    return old.unionByName(new).groupBy(*keys).agg(*[F.max_by(c, "o").alias(c) for c in replaced], *[F.min_by(c, "o").alias(c) for c in kept])


def search_links(links: DataFrame, text: str = "", domain: str | int | None = None) -> DataFrame:
    """Links of a domain (any other value than a number is no condition) whose slug, raw slug
    or title holds the text in any case, by domain and slug."""
    out = links
    if domain is not None and str(domain).strip().lstrip("-").isdigit():
        out = out.where(F.col("domain_id") == int(domain))
    if text:
        held = F.lit(False)
        for c in ("slug", "raw_slug", "title"):
            held = held | F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False))
        out = out.where(held)
    return out.orderBy("domain_id", "slug")


def link_counts(links: DataFrame) -> DataFrame:
    """(domain_id, n_links), repeats counted."""
    return links.groupBy("domain_id").agg(F.count("*").alias("n_links"))


def history(generations: DataFrame, domains: DataFrame, user: int | None = None) -> DataFrame:
    """Generations with their domain if there is one, latest first, as they are shown."""
    rows = generations if user is None else generations.where(F.col("user_id") == user)
    d = domains.select(F.col("id").alias("domain_id"), "base_url")
    shown = rows.join(d, "domain_id", "left").withColumns({
        "shown": X.truncated(F.col("source_excerpt")), "made": F.date_format("created_at", "MMM d, yyyy HH:mm"),
        "priority_links": F.filter("inserted_records", lambda r: r["priority"]), "auto_links": F.filter("inserted_records", lambda r: ~r["priority"])})
    return shown.orderBy(F.desc("created_at"), "id")


def generation_totals(records: Column) -> list[Column]:
    """Total, priority and automatic insertions of an array of records."""
    n = F.coalesce(F.size(F.filter(records, lambda r: r["priority"])), F.lit(0))
    total = F.when(records.isNull(), 0).otherwise(F.size(records))
    return [total.alias("inserted_total"), n.alias("inserted_priority"), (total - n).alias("inserted_auto")]


def missing_priority(generations: DataFrame) -> DataFrame:
    """(id, term): priority terms without a priority insertion, compared as normal terms."""
    asked = generations.select("id", F.explode("priority_pairs").alias("p")).select("id", F.col("p.term").alias("term"), X.normal_term(F.col("p.term")).alias("key"))
    done = generations.select("id", F.explode("inserted_records").alias("r")).where("r.priority").select("id", X.normal_term(F.col("r.term")).alias("key"))
    return asked.join(done, ["id", "key"], "left_anti").select("id", "term").distinct()


def append_generation(rows: DataFrame, path: str) -> None:
    """Add generations to a history table; excerpts are cut to 1000 characters."""
    rows.withColumn("source_excerpt", X.excerpt(F.col("source_excerpt"))).write.mode("append").parquet(path)
