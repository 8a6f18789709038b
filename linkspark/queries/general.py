"""Queries of the general data-processing operators (problems 3 and 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators.hierarchy import closure, descendant_counts, parent_edges, resolve_hierarchy
from linkspark.operators.timestamps import page_timestamps
from linkspark.sources.tables import table

PLAIN_UTC = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\z"


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    found = page_timestamps(table(spark, sf, "page"), table(spark, sf, "site_clock"))
    return found.where(F.col("utc_micros").isNotNull() & ~F.col("published_at").rlike(PLAIN_UTC)).select("page_id", "utc_micros")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    edges = parent_edges(table(spark, sf, "page"))
    tree = resolve_hierarchy(edges)
    named = edges.where("named").select("node")
    return tree.join(named, "node").select(
        F.col("node").alias("page_id"), F.coalesce("root", F.lit(-1).cast("long")).alias("root_id"), F.coalesce("depth", F.lit(-1)).cast("long").alias("depth"), "path")


def p5_descendants(spark: SparkSession, sf: str) -> DataFrame:
    tree = resolve_hierarchy(parent_edges(table(spark, sf, "page")))
    return descendant_counts(tree).select(F.col("node").cast("long").alias("page_id"), F.col("n_descendants").cast("long").alias("n_descendants"))


def p5_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Every ancestor of every page; a page on or below a cycle has one row, with -1 for ancestor and steps."""
    tree = resolve_hierarchy(parent_edges(table(spark, sf, "page")))
    pairs = closure(tree).select(F.col("ancestor").cast("long").alias("ancestor_id"), F.col("node").alias("page_id"), F.col("steps").cast("long").alias("steps"))
    circular = tree.where("root is null").select(F.lit(-1).cast("long").alias("ancestor_id"), F.col("node").alias("page_id"), F.lit(-1).cast("long").alias("steps"))
    return pairs.unionByName(circular)


_EDGES = r"""
WITH RECURSIVE named AS (
  SELECT page_id, url, regexp_replace(metadata.parent_id, '^\s+|\s+$', '', 'g') AS p FROM page),
keyed AS (
  SELECT page_id,
         lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*')) || substr(url, length(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*')) + 1) AS u,
         lower(regexp_extract(p, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*')) || substr(p, length(regexp_extract(p, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*')) + 1) AS pu,
         CASE WHEN regexp_matches(p, '^[0-9]+$') THEN TRY_CAST(p AS BIGINT) END AS pn,
         p IS NOT NULL AND p <> '' AS is_named FROM named),
edges AS (
  SELECT a.page_id AS node, a.is_named, min(coalesce(b.page_id, c.page_id)) AS parent
  FROM keyed a LEFT JOIN keyed b ON a.pn = b.page_id LEFT JOIN keyed c ON a.pn IS NULL AND a.is_named AND a.pu = c.u
  GROUP BY 1, 2),
tree AS (
  SELECT node, node AS root, CAST(0 AS BIGINT) AS depth, CAST(node AS VARCHAR) AS path FROM edges WHERE parent IS NULL
  UNION ALL
  SELECT e.node, t.root, t.depth + 1, t.path || '/' || CAST(e.node AS VARCHAR) FROM edges e JOIN tree t ON e.parent = t.node)
"""

SQL = {
    "p5_found": _EDGES + """
SELECT e.node AS page_id, coalesce(t.root, -1) AS root_id, coalesce(t.depth, -1) AS depth, coalesce(t.path, '') AS path
FROM edges e LEFT JOIN tree t ON e.node = t.node WHERE e.is_named""",
    "p5_descendants": _EDGES + """
, up AS (SELECT CAST(unnest(string_split(path, '/')) AS BIGINT) AS node FROM tree)
SELECT node AS page_id, count(*) - 1 AS n_descendants FROM up GROUP BY 1""",
    "p5_closure": _EDGES + """
, up AS (SELECT node, depth, CAST(unnest(string_split(path, '/')) AS BIGINT) AS ancestor, generate_subscripts(string_split(path, '/'), 1) - 1 AS k FROM tree)
SELECT ancestor AS ancestor_id, node AS page_id, depth - k AS steps FROM up WHERE k < depth
UNION ALL SELECT -1, node, -1 FROM edges WHERE node NOT IN (SELECT node FROM tree)""",
}

QUERIES = {"p3_found": p3_found, "p5_found": p5_found, "p5_descendants": p5_descendants, "p5_closure": p5_closure}
