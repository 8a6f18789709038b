"""Page files in, suggestions out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.operators.corpus import PAGE


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of JSON files that hold one object or an array of them, with a ``page_id`` by
    file and place.  Absent fields are null; :func:`linkspark.operators.corpus.with_defaults`
    gives them their defaults.  A file that is no JSON is an error."""
    raw = spark.read.schema(PAGE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    return raw.withColumn("page_id", F.monotonically_increasing_id())


def suggestion_json(links: DataFrame) -> DataFrame:
    """One JSON object a link, anchors as objects."""
    return links.select(F.to_json(F.struct("target_url", "reason", "score", "anchors", "placement_hint", "rel", "risk_flags")).alias("value"))


def suggestion_tsv(links: DataFrame) -> DataFrame:
    """Score to two places, url and anchor texts, separated by tabs."""
    texts: Column = F.array_join(F.transform("anchors", lambda a: a["text"]), ", ")
    return links.select(F.format_string("%.2f\t%s\t[%s]", "score", "target_url", texts).alias("value"))


def metrics_json(metrics: DataFrame) -> DataFrame:
    return metrics.select(F.to_json(F.struct(*metrics.columns)).alias("value"))
