"""Page rows and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.functions import text as X
from linkspark.functions.scores import iso_instant

ENTITY = T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("type", T.StringType())]))
FLAGS = "has_schema is_login is_cart is_redirect is_paginated_duplicate blocked is_pillar is_hub is_money_page is_conversion_page is_reference".split()
METADATA = T.StructType(
    [T.StructField("entities", ENTITY), *[T.StructField(k, T.ArrayType(T.StringType())) for k in ("outbound_links", "taxonomy", "head_terms")],
     T.StructField("brand", T.StringType()), T.StructField("parent_id", T.StringType()), T.StructField("status_code", T.IntegerType()),
     *[T.StructField(k, T.DoubleType()) for k in ("authority_score", "inlinks", "click_depth", "content_score")], *[T.StructField(k, T.BooleanType()) for k in FLAGS]])
PAGE = T.StructType(
    [T.StructField("url", T.StringType()), T.StructField("title", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("tags", T.ArrayType(T.StringType())), T.StructField("type", T.StringType()), T.StructField("published_at", T.StringType()), T.StructField("canonical", T.StringType()),
     T.StructField("noindex", T.BooleanType()), T.StructField("nofollow", T.BooleanType()), T.StructField("metadata", METADATA)])


def with_defaults(pages: DataFrame) -> DataFrame:
    """Pages with the defaults of absent fields: text falls back to html, type to ``other``,
    flags to false, lists to empty ones.  Null list elements are left out."""
    full = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: x.isNotNull())
    m = lambda k: F.col(f"metadata.{k}")
    return pages.select(
        "page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", "html", F.lit("")).alias("text"), F.nullif(F.col("lang"), F.lit("")).alias("lang"),
        full("tags").alias("tags"), F.coalesce("type", F.lit("other")).alias("type"), iso_instant(F.col("published_at")).alias("published"), F.nullif(F.col("canonical"), F.lit("")).alias("canonical"),
        *[F.coalesce(F.col(k), F.lit(False)).alias(k) for k in ("noindex", "nofollow")], *[F.coalesce(m(k), F.lit(False)).alias(k) for k in FLAGS],
        *[full(f"metadata.{k}").alias(k) for k in ("outbound_links", "taxonomy", "head_terms")], m("entities").alias("entities"), F.nullif(m("brand"), F.lit("")).alias("brand"), m("parent_id").alias("parent_id"),
        F.coalesce(m("status_code"), F.lit(200)).alias("status_code"), *[m(k).alias(k) for k in ("authority_score", "inlinks", "click_depth", "content_score")])


def prepared(pages: DataFrame) -> DataFrame:
    """Pages of :func:`with_defaults` with what scoring needs of their texts: token counts,
    lower-cased tags and entities, stated or else inferred."""
    stated = F.transform(F.filter("entities", lambda e: e["name"].isNotNull()), lambda e: F.struct(e["name"].alias("name"), F.coalesce(e["type"], F.lit("generic")).alias("type")))
    inferred = F.transform(X.capitalised_phrases(F.col("text")), lambda p: F.struct(p.alias("name"), F.lit("generic").alias("type")))
    return pages.withColumns({
        "title_tokens": X.tokens(F.col("title")), "body_tokens": X.tokens(F.col("text")), "n_words": F.size(X.words(F.col("text"))),
        "tag_set": F.array_distinct(F.transform("tags", F.lower)), "entities": F.when(F.size(stated) > 0, stated).otherwise(inferred),
    }).withColumns({"title_len": F.size("title_tokens"), "body_len": F.size("body_tokens")})


def postings(pages: DataFrame) -> DataFrame:
    """(field, page_id, term, tf, len) of prepared pages, fields ``title`` and ``body``."""
    one = lambda f: pages.select(F.lit(f).alias("field"), "page_id", F.explode(f"{f}_tokens").alias("term"), F.col(f"{f}_len").alias("len"))
    return one("title").unionByName(one("body")).groupBy("field", "page_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))


def document_frequency(posts: DataFrame) -> DataFrame:
    return posts.groupBy("field", "term").agg(F.count("*").alias("df"))


def corpus_stats(pages: DataFrame) -> DataFrame:
    """One row: pages and mean lengths, 1 for an empty corpus."""
    return pages.agg(F.count("*").alias("n"), F.coalesce(F.avg("title_len"), F.lit(1.0)).alias("title_avg"), F.coalesce(F.avg("body_len"), F.lit(1.0)).alias("body_avg"))
