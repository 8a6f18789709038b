"""Queries of this package's operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkspark.llm.contamination import leaked_items
from linkspark.llm.languages import fit_model, line_languages, page_languages, stated_language
from linkspark.llm.main_content import line_roles, main_texts
from linkspark.llm.mixture import Mix, counted, mix_sources
from linkspark.llm.near_duplicates import near_duplicate_groups, near_duplicates
from linkspark.llm.sentences import sentence_units
from linkspark.llm.set_pairs import expand_pairs, normal_items, similar_sets
from linkspark.sources.tables import table


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return line_roles(table(spark, sf, "page")).where("not main").select(F.col("id").alias("page_id"), "line_no")


def p4_text(spark: SparkSession, sf: str) -> DataFrame:
    """The main text of every page, rendered."""
    return main_texts(table(spark, sf, "page")).withColumnRenamed("id", "page_id")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    links, members = similar_sets(table(spark, sf, "page"), "page_id", normal_items(F.col("tags")), threshold=0.6, min_size=3)
    return expand_pairs(links, members).select(F.col("id_a").alias("page_id_a"), F.col("id_b").alias("page_id_b"))


def _line_languages(spark: SparkSession, sf: str) -> DataFrame:
    page = table(spark, sf, "page")
    model = fit_model(table(spark, sf, "lang_sample"), page)
    return line_languages(page, "page_id", "text", model)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    stated = table(spark, sf, "page").select(F.col("page_id").alias("id"), stated_language(F.col("lang")).alias("stated"))
    lines = _line_languages(spark, sf).where("counts")
    return lines.join(stated, "id").where("stated is null or lang_code <> stated").select(F.col("id").alias("page_id"), "line_no", "lang_code")


def p1_pages(spark: SparkSession, sf: str) -> DataFrame:
    return page_languages(_line_languages(spark, sf)).withColumnRenamed("id", "page_id")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    links, members = near_duplicates(table(spark, sf, "page"), "page_id", "text", threshold=0.7)
    return expand_pairs(links.select("a", "b"), members).select(F.col("id_a").alias("page_id_a"), F.col("id_b").alias("page_id_b"))


def p2_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every page that has near-duplicates with its group, and whether its canonical names another page of the group."""
    page = table(spark, sf, "page")
    grouped = near_duplicate_groups(*near_duplicates(page, "page_id", "text", threshold=0.7)).select(F.col("id").alias("page_id"), F.col("group").alias("group_id"))
    own = grouped.join(page.where("page_id is not null").select("page_id", "url", "canonical").dropDuplicates(["page_id"]), "page_id")
    urls = own.select("group_id", F.col("url").alias("canonical"), F.col("page_id").alias("other"))
    named = own.join(urls, ["group_id", "canonical"]).where("other <> page_id").select("page_id").distinct().withColumn("admits", F.lit(True))
    return grouped.join(named, "page_id", "left").select("page_id", "group_id", F.coalesce("admits", F.lit(False)).alias("admits"))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return leaked_items(table(spark, sf, "documents"), "doc_id", "text", table(spark, sf, "eval_item"), "item_id", ["prompt", "answer"]).select("doc_id", "item_id")


def _mix(spark: SparkSession, sf: str) -> Mix:
    vocabulary = spark.conf.get("spark.linkspark.vocabulary", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    return mix_sources(counted(table(spark, sf, "documents"), vocabulary), table(spark, sf, "mix_target"))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).report


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """The sources that raking leaves below their target."""
    return _mix(spark, sf).report.where("short").select("source")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Wanted and fitted shares of the mix by language and topic."""
    return _mix(spark, sf).shares


def p8_sample(spark: SparkSession, sf: str) -> DataFrame:
    return _mix(spark, sf).sample.withColumnRenamed("id", "doc_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return sentence_units(table(spark, sf, "documents"), "doc_id", "text", "msg_start", "msg_end").withColumnRenamed("id", "doc_id")


QUERIES = {"p1_found": p1_found, "p1_pages": p1_pages, "p4_found": p4_found, "p4_text": p4_text, "p2_found": p2_found, "p2_groups": p2_groups, "p8_found": p8_found, "p8_report": p8_report, "p8_shares": p8_shares, "p8_sample": p8_sample, "p9_found": p9_found, "p7_found": p7_found, "p6_found": p6_found}

_WS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_SOLO = r"\x{3040}-\x{30ff}\x{3400}-\x{9fff}\x{0e00}-\x{0e7f}"
_P2 = rf"""
WITH RECURSIVE w AS (SELECT page_id, regexp_extract_all(lower(text), '[{_SOLO}]|[^{_WS}{_SOLO}]+') AS w FROM page),
g AS (SELECT DISTINCT page_id, list_aggregate(w[k:k + 4], 'string_agg', ' ') AS g FROM (SELECT page_id, w, unnest(range(1, len(w) - 3)) AS k FROM w)),
n AS (SELECT page_id, count(*) AS n FROM g GROUP BY 1),
k AS (SELECT a.page_id AS a, b.page_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.page_id < b.page_id GROUP BY 1, 2),
pairs AS (SELECT a, b FROM k JOIN n x ON x.page_id = a JOIN n y ON y.page_id = b WHERE k.k >= 0.7 * (x.n + y.n - k.k))
"""
_RUNS = r"regexp_extract_all(lower({0}), '[\p{L}\p{N}]+')"
_WINDOWS = "list_aggregate(w[k:k + 11], 'string_agg', ' ')"

SQL = {
    "p6_found": r"""
WITH t AS (SELECT page_id, unnest(tags) AS x FROM page),
n AS (SELECT DISTINCT page_id, trim(regexp_replace(lower(x), '[-_\s]+', ' ', 'g')) AS x FROM t WHERE x IS NOT NULL),
s AS (SELECT page_id, x, count(*) OVER (PARTITION BY page_id) AS n FROM n WHERE x <> ''),
p AS (SELECT a.page_id AS a, b.page_id AS b, min(a.n) AS na, min(b.n) AS nb, count(*) AS k
      FROM s a JOIN s b ON a.x = b.x AND a.page_id < b.page_id WHERE a.n >= 3 AND b.n >= 3 GROUP BY 1, 2)
SELECT a AS page_id_a, b AS page_id_b FROM p WHERE k * 1.0 / (na + nb - k) >= 0.6""",
    "p2_found": _P2 + "SELECT a AS page_id_a, b AS page_id_b FROM pairs",
    "p2_groups": _P2 + """,
reach AS (SELECT a, b FROM (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) UNION SELECT r.a, e.b FROM reach r JOIN (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs) e ON e.a = r.b),
g2 AS (SELECT a AS page_id, min(b) AS group_id FROM reach GROUP BY 1)
SELECT g2.page_id, g2.group_id, coalesce(bool_or(o.url = p.canonical AND o.page_id <> p.page_id), false) AS admits
FROM g2 JOIN page p USING (page_id) JOIN g2 h ON h.group_id = g2.group_id JOIN page o ON o.page_id = h.page_id GROUP BY 1, 2""",
    "p7_found": f"""
WITH i AS (SELECT item_id, {_RUNS.replace("{0}", "prompt")} AS w FROM eval_item UNION ALL SELECT item_id, {_RUNS.replace("{0}", "answer")} FROM eval_item),
iw AS (SELECT DISTINCT item_id, {_WINDOWS} AS x FROM (SELECT item_id, w, unnest(range(1, len(w) - 10)) AS k FROM i)),
d AS (SELECT doc_id, {_RUNS.replace("{0}", "text")} AS w FROM documents),
dw AS (SELECT doc_id, {_WINDOWS} AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS k FROM d))
SELECT DISTINCT doc_id, item_id FROM dw JOIN iw USING (x)""",
    # the cases don't depend on the tokenizer, so bytes stand for tokens
    "p8_found": """
WITH s AS (SELECT lower(trim(source)) AS source, sum(strlen(text)) AS n FROM documents GROUP BY 1)
SELECT lower(trim(m.source)) AS source FROM mix_target m LEFT JOIN s ON s.source = lower(trim(m.source))
WHERE coalesce(s.n, 0) * max_repeats < target_share * (SELECT sum(strlen(text)) / 2 FROM documents)""",
}
