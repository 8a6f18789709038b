"""Queries of the link-suggestion operators over the page table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.functions import scores as S
from linkspark.functions import text as X
from linkspark.operators import relevance as R
from linkspark.operators.anchors import with_anchors
from linkspark.operators.blocks import best_pairs
from linkspark.operators.corpus import corpus_stats, document_frequency, postings, prepared, with_defaults
from linkspark.operators.selection import enforce_roles, inbound_counts, variant_counts
from linkspark.plans import suggest
from linkspark.plans.config import settings
from linkspark.sources.pages import suggestion_json, suggestion_tsv
from linkspark.sources.tables import table

CONFIG = settings()
SIX = 6


def _raw(spark: SparkSession, sf: str) -> DataFrame:
    return with_defaults(table(spark, sf, "page"))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    return prepared(_raw(spark, sf))


def _ready(spark: SparkSession, sf: str, texts: bool = False) -> DataFrame:
    return suggest.ready(table(spark, sf, "page"), texts)


def r6(c: str, name: str | None = None):
    return F.round(c, SIX).alias(name or c)


def tokenize_counts(spark, sf):
    return _pages(spark, sf).select("page_id", F.col("title_len").cast("long").alias("title_tokens"), F.col("body_len").cast("long").alias("body_tokens"), F.col("n_words").cast("long").alias("n_words"))


def term_frequency(spark, sf):
    return postings(_pages(spark, sf)).select("field", "page_id", "term", "tf")


def term_document_frequency(spark, sf):
    return document_frequency(postings(_pages(spark, sf)))


def corpus_statistics(spark, sf):
    return corpus_stats(_pages(spark, sf)).select("n", r6("title_avg"), r6("body_avg"))


def bm25_idf(spark, sf):
    n = table(spark, sf, "page").agg(F.count("*").alias("n"))
    return document_frequency(postings(_pages(spark, sf))).crossJoin(F.broadcast(n)).select("field", "term", F.round(S.idf(F.col("n"), F.col("df")), SIX).alias("idf"))


def body_norms(spark, sf):
    return postings(_pages(spark, sf)).where("field = 'body'").groupBy("page_id").agg(F.round(F.sqrt(F.sum(F.col("tf") * F.col("tf")).cast("double")), SIX).alias("norm"))


def _best(spark, sf, own: str = "", theirs: str = "", gated: bool = False, entity: bool = False) -> DataFrame:
    """The 120 best targets of every page by recall, of all or of those that pass the business filter, with some attributes of both pages."""
    p = _ready(spark, sf)
    return R.candidates(p, p, CONFIG, gated, own.split(), theirs.split(), entity)


def pair_relevance(spark, sf):
    return _best(spark, sf, entity=True).select("src", "tgt", *[r6(c) for c in ("title_bm25", "body_bm25", "cosine", "entity", "tag")], F.col("first_entity.name").alias("entity_name"), F.col("first_entity.type").alias("entity_type"))


def _topk(spark, sf, by: str, k: int = 10) -> DataFrame:
    """The feature of a report: the ten best targets of each source."""
    p = suggest.ready_field(table(spark, sf, "page"), by.split("_")[0])
    return best_pairs(p, p, k, by, 0.0, SIX, gated=False, alone=True).select("src", "tgt", F.col("rank").cast("long").alias("place"), r6(by))


def bm25_title_topk(spark, sf):
    return _topk(spark, sf, "title_bm25")


def bm25_body_topk(spark, sf):
    return _topk(spark, sf, "body_bm25")


def taxonomy_overlap(spark, sf):
    return _best(spark, sf, "taxonomy", "taxonomy").select("src", "tgt", F.round(S.overlap(R.s("taxonomy"), R.t("taxonomy")), SIX).alias("taxonomy")).where("taxonomy > 0")


def business_filter(spark, sf):
    return _best(spark, sf, "url canonical", "url canonical noindex nofollow is_login is_cart status_code").where(R.business_filter()).select("src", "tgt")


def allow_candidates(spark, sf):
    return _best(spark, sf, "url lang tag_set", "url lang tag_set canonical noindex nofollow is_redirect is_paginated_duplicate blocked status_code").where(R.guardrails(CONFIG)).select("src", "tgt")


def pair_factors(spark, sf):
    pairs = _best(spark, sf, "lang tags tag_set type taxonomy parent_id outbound_links", "url title lang tags tag_set type taxonomy parent_id body_len is_pillar is_hub is_money_page is_conversion_page is_reference")
    return pairs.select("src", "tgt", R.language_factor().alias("language"), R.review_factor().alias("review"), R.placement().alias("placement"), R.role().alias("role"), F.array_join(R.risk_flags(CONFIG), ",").alias("flags"))


def recall_candidates(spark, sf):
    p = _ready(spark, sf)
    return best_pairs(p, p, CONFIG["max_candidates"]).select("src", "tgt", r6("recall"))


def _scored(spark, sf):
    pairs = _best(spark, sf, "lang published taxonomy outbound_links", "url lang published taxonomy type body_len has_schema authority_score inlinks click_depth content_score", gated=True)
    return R.scored(pairs, CONFIG, suggest.AS_OF)


def features_wide(spark, sf):
    df = _scored(spark, sf)
    return df.select("src", "tgt", *[r6(k) for k in R.features(CONFIG, suggest.AS_OF)])


def score_pairs(spark, sf):
    return _scored(spark, sf).select("src", "tgt", r6("score"))


def reason_text(spark, sf):
    return _scored(spark, sf).select("src", "tgt", "reason")


def link_budgets(spark, sf):
    return _pages(spark, sf).select("page_id", S.link_budget(F.col("n_words"), 3, 12).cast("long").alias("budget"))


def anchor_select(spark, sf):
    p = _ready(spark, sf, texts=True)
    df = with_anchors(best_pairs(p, p, CONFIG["max_candidates"], spans=True), CONFIG)
    flat = df.select("src", "tgt", F.posexplode("anchors").alias("place", "a"))
    return flat.select("src", "tgt", F.col("place").cast("long").alias("place"), F.col("a.text").alias("text"), F.col("a.start").cast("long").alias("start_off"), F.col("a.end").cast("long").alias("end_off"), F.col("a.variant").alias("variant"))


def inferred_entities(spark, sf):
    return _raw(spark, sf).select("page_id", F.posexplode(X.capitalised_phrases(F.col("text"))).alias("pos", "name")).select("page_id", F.col("pos").cast("long").alias("pos"), "name")


def suggestions(spark, sf):
    links = suggest.suggest_links(table(spark, sf, "page"))
    return links.select("src", F.col("place").cast("long").alias("place"), "target_url", "reason", r6("score"), F.array_join(F.transform("anchors", lambda a: a["text"]), "|").alias("anchors"), "placement_hint", "rel", F.array_join("risk_flags", ",").alias("risk_flags"), "role")


def suggestions_json(spark, sf):
    return suggestion_json(suggest.suggest_links(table(spark, sf, "page")))


def suggestions_tsv(spark, sf):
    return suggestion_tsv(suggest.suggest_links(table(spark, sf, "page")))


def dry_run_metrics(spark, sf):
    m = suggest.dry_run(table(spark, sf, "page"))
    return m.select(*[r6(c) for c in m.columns if c != "anchor_variant_counts"], F.to_json("anchor_variant_counts").alias("anchor_variant_counts"))


def suggestion_inbound(spark, sf):
    links, _, _, corpus = suggest.batch(table(spark, sf, "page"))
    return inbound_counts(links, corpus)


def suggestion_variants(spark, sf):
    return variant_counts(suggest.batch(table(spark, sf, "page"))[0])


def role_links(spark, sf):
    """The three best pairs of each source by recall, completed by a parent and a sibling."""
    evaluated = suggest.batch(table(spark, sf, "page"))[1]
    w = Window.partitionBy("src").orderBy("rank")
    chosen = evaluated.select("src", "tgt", F.row_number().over(w).alias("place")).where("place <= 3")
    return enforce_roles(evaluated, chosen, CONFIG).select("src", F.col("place").cast("long").alias("place"), "tgt", "role", r6("score"))


QUERIES = {f.__name__: f for f in (
    tokenize_counts, term_frequency, term_document_frequency, corpus_statistics, bm25_idf, body_norms, pair_relevance, bm25_title_topk, bm25_body_topk, taxonomy_overlap, business_filter, allow_candidates, pair_factors,
    recall_candidates, features_wide, score_pairs, reason_text, link_budgets, anchor_select, inferred_entities, suggestions, suggestions_json, suggestions_tsv, dry_run_metrics, suggestion_inbound, suggestion_variants, role_links)}

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _tok(x: str) -> str:
    return rf"list_transform(regexp_extract_all({x}, '[\p{{L}}\p{{N}}_'']+'), lambda x: lower(x))"


def _words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '{WS}+'), lambda x: x <> '')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


_FLAGS = "has_schema is_login is_cart is_redirect is_paginated_duplicate blocked is_pillar is_hub is_money_page is_conversion_page is_reference".split()
_ISO = r"'^\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d([.]\d+)?)?([+-]\d\d:?\d\d)?)?$'"

#: Common table expressions shared by the statements below; one that isn't used costs nothing.
_BASE = f"""
WITH RECURSIVE p0 AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(title, '') AS title, coalesce(text, html, '') AS text, nullif(lang, '') AS lang,
    list_filter(coalesce(tags, []), lambda x: x IS NOT NULL) AS tags, coalesce(type, 'other') AS type,
    regexp_replace(published_at, '[Zz]$', '+00:00') AS pub,
    nullif(canonical, '') AS canonical, coalesce(noindex, false) AS noindex, coalesce(nofollow, false) AS nofollow,
    {", ".join(f"coalesce(metadata.{k}, false) AS {k}" for k in _FLAGS)},
    {", ".join(f"list_filter(coalesce(metadata.{k}, []), lambda x: x IS NOT NULL) AS {k}" for k in ("outbound_links", "taxonomy", "head_terms"))},
    metadata.entities AS entities, nullif(metadata.brand, '') AS brand, metadata.parent_id AS parent_id, coalesce(metadata.status_code, 200) AS status_code,
    metadata.authority_score AS authority_score, metadata.inlinks AS inlinks, metadata.click_depth AS click_depth, metadata.content_score AS content_score
  FROM page),
p AS (SELECT *, {_tok('title')} AS title_tokens, {_tok('text')} AS body_tokens, len({_words('text')}) AS n_words,
    list_distinct(list_transform(tags, lambda x: lower(x))) AS tag_set,
    CASE WHEN regexp_full_match(pub, '\\d{{8}}') THEN TRY_CAST(substr(pub,1,4)||'-'||substr(pub,5,2)||'-'||substr(pub,7,2) AS TIMESTAMP)
      WHEN regexp_matches(pub, {_ISO}) THEN TRY_CAST(regexp_replace(pub, '(:\\d\\d)([.]\\d+)?[+-]\\d\\d:?\\d\\d$|([+-]\\d\\d:?\\d\\d)$', '\\1\\2') AS TIMESTAMP)
        - CASE WHEN regexp_matches(pub, ':\\d\\d([.]\\d+)?[+-]\\d\\d:?\\d\\d$')
          THEN (CASE WHEN regexp_matches(pub, '-\\d\\d:?\\d\\d$') THEN -1 ELSE 1 END) * to_minutes(60 * CAST(regexp_extract(pub, '[+-](\\d\\d):?\\d\\d$', 1) AS INT) + CAST(right(pub, 2) AS INT))
          ELSE to_minutes(0) END
    END AS published FROM p0),
post AS (
  SELECT 'title' AS field, page_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT page_id, unnest(title_tokens) AS term, len(title_tokens) AS n FROM p) GROUP BY page_id, term
  UNION ALL
  SELECT 'body', page_id, term, count(*), any_value(n) FROM (SELECT page_id, unnest(body_tokens) AS term, len(body_tokens) AS n FROM p) GROUP BY page_id, term),
df AS (SELECT field, term, count(*) AS df FROM post GROUP BY 1, 2),
st AS (SELECT count(*) AS n, avg(len(title_tokens)) AS title_avg, avg(len(body_tokens)) AS body_avg FROM p),
wp AS (SELECT post.field, post.term, page_id, tf,
    ln(1 + (st.n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * post.n / CASE WHEN (CASE WHEN post.field = 'title' THEN title_avg ELSE body_avg END) > 0 THEN (CASE WHEN post.field = 'title' THEN title_avg ELSE body_avg END) ELSE 1 END)) AS w
  FROM post JOIN df ON post.field = df.field AND post.term = df.term CROSS JOIN st),
ent0 AS (
  SELECT page_id, list_filter(entities, lambda e: e.name IS NOT NULL) AS stated,
    regexp_extract_all(regexp_replace(regexp_replace(text, '[^\\x00-\\x7F\\p{{L}}\\p{{N}}]', '|', 'g'), '[A-Za-z0-9_]*(?:[^\\x00-\\x7F][A-Za-z0-9_]*)+', '_', 'g'), '\\b([A-Z][a-zA-Z0-9\\-'']+(?:\\s+[A-Z][a-zA-Z0-9\\-'']+)*)\\b') AS found
  FROM p0),
inferred AS (SELECT page_id, list_filter(found, lambda x: len({_words('x')}) <= 6) AS names, stated FROM ent0),
ent AS (
  SELECT page_id, unnest(range(len(stated))) AS pos, unnest(list_transform(stated, lambda e: e.name)) AS name, coalesce(unnest(list_transform(stated, lambda e: e.type)), 'generic') AS type FROM inferred WHERE len(stated) > 0
  UNION ALL
  SELECT page_id, unnest(range(len(names))), unnest(names), 'generic' FROM inferred WHERE coalesce(len(stated), 0) = 0),
entw AS (SELECT *, lower(name) AS key, CASE type WHEN 'product' THEN 1.0 WHEN 'brand' THEN 0.8 WHEN 'category' THEN 0.6 ELSE 0.3 END AS w FROM ent),
tent AS (SELECT page_id, key, arg_max(type, pos) AS type, arg_max(w, pos) AS w FROM entw GROUP BY 1, 2),
etot AS (SELECT page_id, sum(w) AS total FROM entw GROUP BY 1),
norm AS (SELECT page_id, sqrt(sum(tf * tf)) AS norm FROM post WHERE field = 'body' GROUP BY 1),
pt AS (SELECT a.page_id AS src, b.page_id AS tgt, sum(CASE WHEN a.field = 'title' THEN a.tf * b.w ELSE 0 END) AS title_bm25, sum(CASE WHEN a.field = 'body' THEN a.tf * b.w ELSE 0 END) AS body_bm25,
    sum(CASE WHEN a.field = 'body' THEN a.tf * b.tf ELSE 0 END) AS dot
  FROM post a JOIN wp b ON a.field = b.field AND a.term = b.term AND a.page_id <> b.page_id GROUP BY 1, 2),
pe AS (SELECT a.page_id AS src, b.page_id AS tgt, sum(greatest(a.w, b.w)) AS matched, arg_min(a.name, a.pos) AS entity_name, arg_min(b.type, a.pos) AS entity_type
  FROM entw a JOIN tent b ON a.key = b.key AND a.page_id <> b.page_id GROUP BY 1, 2),
tg AS (SELECT page_id, unnest(tag_set) AS t, len(tag_set) AS n FROM p),
pg AS (SELECT a.page_id AS src, b.page_id AS tgt, count(*) * 1.0 / (any_value(a.n) + any_value(b.n) - count(*)) AS tag FROM tg a JOIN tg b ON a.t = b.t AND a.page_id <> b.page_id GROUP BY 1, 2),
pr0 AS (SELECT src, tgt, sum(title_bm25) AS title_bm25, sum(body_bm25) AS body_bm25, sum(dot) AS dot, sum(matched) AS matched, max(entity_name) AS entity_name, max(entity_type) AS entity_type, sum(tag) AS tag FROM (
    SELECT src, tgt, title_bm25, body_bm25, dot, 0.0 AS matched, NULL AS entity_name, NULL AS entity_type, 0.0 AS tag FROM pt
    UNION ALL SELECT src, tgt, 0, 0, 0, matched, entity_name, entity_type, 0 FROM pe
    UNION ALL SELECT src, tgt, 0, 0, 0, 0, NULL, NULL, tag FROM pg) GROUP BY 1, 2),
pr AS (SELECT src, tgt, title_bm25, body_bm25, coalesce(dot / (a.norm * b.norm), 0) AS cosine, CASE WHEN total > 0 THEN least(matched / total, 1) ELSE 0 END AS entity, entity_name, entity_type, tag
  FROM pr0 LEFT JOIN norm a ON a.page_id = src LEFT JOIN norm b ON b.page_id = tgt LEFT JOIN etot e ON e.page_id = src),
pa AS (SELECT pr.*, s, t FROM pr JOIN p AS s ON s.page_id = src JOIN p AS t ON t.page_id = tgt),
q AS (SELECT *, string_split(regexp_extract(t.url, '^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?', 4), '&') AS args,
    s.lang IS NOT NULL AND t.lang IS NOT NULL AS both_lang, len(list_intersect(s.tag_set, t.tag_set)) > 0 AS share_tag FROM pa),
f AS (SELECT *,
    s.url <> t.url AND NOT t.noindex AND NOT t.nofollow AND NOT coalesce(s.canonical = t.canonical, false) AND NOT t.is_login AND NOT t.is_cart AND t.status_code < 300
      AND NOT (contains(t.url, '?') AND len(list_filter(args, lambda a: regexp_matches(a, '^[^=]+=.') AND NOT (lower(a) LIKE 'utm%' OR lower(a) LIKE 'ref%' OR lower(a) LIKE 'replytocom=%'))) = 0) AS business,
    s.url <> t.url AND NOT t.noindex AND NOT t.nofollow AND (t.canonical IS NULL OR t.canonical = t.url) AND NOT t.is_redirect AND t.status_code < 300 AND NOT t.is_paginated_duplicate
      AND NOT contains(t.url, 'login') AND NOT contains(t.url, 'cart') AND NOT t.blocked AND (NOT (both_lang AND s.lang <> t.lang) OR share_tag) AS allowed,
    CASE WHEN NOT both_lang THEN 0.7 WHEN s.lang = t.lang THEN 1.0 WHEN share_tag THEN 0.6 ELSE 0.1 END AS language,
    CASE WHEN s.type <> 'review' THEN 1.0 WHEN t.type IN ('category', 'review') AND regexp_matches(lower(t.title), 'best|top|guide') THEN 1.2 WHEN t.type = 'product' THEN 1.1 ELSE 1.0 END AS review
  FROM q),
rc AS (SELECT *, (0.35 * least(title_bm25 / 8, 1) + 0.35 * least(body_bm25 / 12, 1) + 0.2 * cosine + 0.25 * entity + 0.15 * tag) * language * review AS recall FROM f),
ca AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(recall, 9) DESC, tgt) AS rank FROM rc WHERE recall > 0.05 QUALIFY rank <= 120),
c AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(recall, 9) DESC, tgt) AS rank FROM rc WHERE business AND recall > 0.05 QUALIFY rank <= 120),
ft AS (SELECT *,
    greatest(least(title_bm25 / 8, 1), 0) AS f_title_bm25, greatest(least(body_bm25 / 12, 1), 0) AS f_body_bm25, greatest(least(cosine, 1), 0) AS f_semantic, entity AS f_entity_overlap, tag AS f_tag_overlap,
    CASE WHEN len(s.taxonomy) > 0 AND len(t.taxonomy) > 0 THEN len(list_distinct(list_intersect(s.taxonomy, t.taxonomy))) * 1.0 / greatest(len(s.taxonomy), len(t.taxonomy)) ELSE 0 END AS f_taxonomy_distance,
    greatest(least(CASE WHEN coalesce(t.authority_score, 0) <> 0 THEN t.authority_score ELSE coalesce(t.inlinks, 0) / 50 END, 1), 0) AS f_authority,
    greatest(least(1 - (coalesce(t.click_depth, 3) - 1) / 6, 1), 0) AS f_click_depth, CASE WHEN t.type IN ('review', 'category', 'product') THEN 1.0 ELSE 0.3 END AS f_conversion_intent,
    CASE WHEN list_contains(s.outbound_links, t.url) THEN 1.0 ELSE 0.0 END AS f_duplicate_risk, CASE WHEN NOT both_lang THEN 0.7 WHEN s.lang = t.lang THEN 1.0 ELSE 0.3 END AS f_lang_match,
    1 - CASE WHEN NOT both_lang THEN 0.7 WHEN s.lang = t.lang THEN 1.0 ELSE 0.3 END AS f_lang_mismatch,
    greatest(least(0.6 * least(len(t.body_tokens) / 800, 1) + 0.4 * CASE WHEN t.has_schema THEN greatest(coalesce(t.content_score, 0), 0.6) ELSE coalesce(t.content_score, 0) END, 1), 0) AS f_quality,
    CASE WHEN t.published IS NULL THEN 0.4 ELSE greatest(least(greatest(0.1, 1 - abs(floor((epoch_us(coalesce(s.published, TIMESTAMP '2025-01-01')) - epoch_us(t.published)) / 86400000000.0)) / 180), 1), 0) END AS f_freshness
  FROM c),
sc AS (SELECT *, 1 / (1 + exp(-(1.4 * f_title_bm25 + 1.1 * f_body_bm25 + 1.2 * f_semantic + 1.5 * f_entity_overlap + 0.9 * f_tag_overlap + 0.7 * f_taxonomy_distance + 0.8 * f_authority + 0.7 * f_click_depth
    + 0.6 * f_conversion_intent + 0.5 * f_lang_match + 0.8 * f_quality + 0.4 * f_freshness - 2.5 * f_duplicate_risk - 1.0 * f_lang_mismatch))) AS score FROM ft)
"""
_FEATURES = "f_title_bm25 f_body_bm25 f_semantic f_entity_overlap f_tag_overlap f_taxonomy_distance f_authority f_click_depth f_conversion_intent f_duplicate_risk f_lang_match f_lang_mismatch f_quality f_freshness".split()
_SAID = {"f_title_bm25": (1.4, "strong title match"), "f_body_bm25": (1.1, "content overlap"), "f_semantic": (1.2, "semantic similarity"), "f_entity_overlap": (1.5, "shared entities"), "f_tag_overlap": (0.9, "tag overlap"),
         "f_taxonomy_distance": (0.7, None), "f_authority": (0.8, "authoritative target"), "f_click_depth": (0.7, "shallow depth"), "f_conversion_intent": (0.6, "conversion intent"), "f_freshness": (0.4, "recent update"),
         "f_lang_match": (0.5, "language match"), "f_quality": (0.8, "high-quality target")}
_WEIGHED = " UNION ALL ".join(f"SELECT src, tgt, {w} * {k} AS v, '{k}' AS k, {k} AS f, {f"'{said}'" if said else 'NULL'} AS said FROM sc WHERE {k} > 0" for k, (w, said) in _SAID.items())
_STOP = "('the','and','or','to','of','a','in','for','on','with','at','by','an','be','is')"
_SHORT = "IN ('entity', 'brand', 'tag')"

_REASONS = f""", wv AS ({_WEIGHED}),
top AS (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY v DESC, k DESC) AS n FROM wv QUALIFY n <= 2),
reasons AS (SELECT src, tgt, coalesce(string_agg(CASE WHEN f >= 0.85 THEN 'excellent ' WHEN f >= 0.6 THEN 'strong ' ELSE 'good ' END || said, '; ' ORDER BY n), '') AS reason FROM top GROUP BY 1, 2)
"""


def _anchors(pairs: str) -> str:
    """``an``: the anchors of the pairs of a common table expression.  What depends on a page alone is made by page."""
    return f""", tt AS (SELECT page_id, {_strip('title')} AS name, {_words('title')} AS tw, lower(title) AS ltitle, lower(text) AS ltext, brand, head_terms, tags FROM p),
pp AS (
  SELECT page_id, name AS phrase, 'exact' AS variant FROM tt
  UNION SELECT page_id, CASE WHEN len(tw) <= 4 THEN name ELSE array_to_string(tw[1:4], ' ') END, 'partial' FROM tt
  UNION SELECT page_id, CASE WHEN len(tw) <= 4 THEN name ELSE array_to_string(tw[-3:], ' ') END, 'partial' FROM tt
  UNION SELECT page_id, brand, 'brand' FROM tt WHERE brand IS NOT NULL
  UNION SELECT page_id, unnest(head_terms), 'partial' FROM tt
  UNION SELECT page_id, replace(g, '-', ' '), 'tag' FROM (SELECT page_id, ltitle, ltext, {_strip("unnest(tags)")} AS g FROM tt) WHERE g <> '' AND (contains(ltitle, lower(g)) OR contains(ltext, lower(g)))),
ph AS (
  SELECT src, tgt, {_strip('phrase')} AS phrase, variant FROM {pairs} JOIN pp ON page_id = tgt
  UNION SELECT src, tgt, {_strip('entity_name')}, CASE WHEN entity_type IN ('entity', 'exact', 'partial', 'brand', 'tag', 'generic') THEN entity_type ELSE 'entity' END FROM {pairs} WHERE entity_name IS NOT NULL),
po AS (SELECT src, tgt, variant, phrase, ltext, text, instr(ltext, lower(phrase)) - 1 AS start_off, length(phrase) AS n FROM ph JOIN (SELECT page_id, text, lower(text) AS ltext FROM p) ON page_id = src WHERE phrase <> '' AND instr(ltext, lower(phrase)) > 0),
pv AS (SELECT *, {_words('phrase')} AS w FROM po),
pw AS (SELECT src, tgt, variant, start_off, start_off + n AS end_off, length(text) AS full_n, substr(text, start_off + 1, n) AS a FROM pv
  WHERE CASE WHEN variant {_SHORT} THEN len(w) BETWEEN 1 AND 5 ELSE len(w) BETWEEN 2 AND 7 AND len(list_filter(w, lambda x: lower(x) NOT IN {_STOP})) > 0 END),
px AS (SELECT *, {_words('a')} AS w, CASE variant WHEN 'entity' THEN 1.0 WHEN 'exact' THEN 0.95 WHEN 'partial' THEN 0.8 WHEN 'brand' THEN 0.75 WHEN 'tag' THEN 0.7 WHEN 'generic' THEN 0.6 ELSE 0.5 END AS vw,
  lower(regexp_replace({_strip('a')}, '{WS}+', ' ', 'g')) AS norm FROM pw),
py AS (SELECT *, vw * (0.7 + 0.2 * (1 - start_off * 1.0 / greatest(full_n, 1)) + 0.1 * greatest(0, 1 - abs(len(w) - 4) / 10.0)) AS sc, row_number() OVER (PARTITION BY src, tgt, norm ORDER BY vw DESC, start_off, end_off, a, variant) AS r1
  FROM px WHERE len(list_filter(w, lambda x: lower(x) NOT IN {_STOP})) > 0 AND CASE WHEN variant {_SHORT} THEN len(w) = 1 ELSE len(w) BETWEEN 2 AND 7 END),
pz AS (SELECT *, row_number() OVER (PARTITION BY src, tgt ORDER BY round(sc, 9) DESC, start_off, end_off, norm) AS r2 FROM py WHERE r1 = 1 QUALIFY r2 <= 2),
an AS (SELECT src, tgt, row_number() OVER (PARTITION BY src, tgt ORDER BY start_off, r2) - 1 AS place, a AS text, start_off, end_off, variant FROM pz)
"""


#: ``ev``: the pairs that stand for choice; ``picked``: those taken, each source's list walked in order.
_CHOICE = _REASONS + f""",
ev0 AS (SELECT src, tgt, rank, score, entity_name, entity_type, t.url AS url, least(3 + greatest(s.n_words, 1) // 500, 12) AS budget,
    list_filter([CASE WHEN both_lang AND s.lang <> t.lang THEN 'lang_mismatch' END, CASE WHEN t.type = 'product' AND len(t.body_tokens) < 250 THEN 'thin_target' END, CASE WHEN list_contains(s.outbound_links, t.url) THEN 'dup_anchor' END], lambda x: x IS NOT NULL) AS flags,
    CASE WHEN t.is_pillar OR t.type IN ('category', 'pillar') THEN 'intro' WHEN t.is_conversion_page THEN 'body' WHEN t.is_reference THEN 'conclusion' ELSE 'body' END AS placement,
    CASE WHEN t.is_pillar OR t.is_hub OR (len(t.taxonomy) > 0 AND s.taxonomy[1:len(t.taxonomy)] = t.taxonomy) THEN 'parent'
      WHEN coalesce(s.parent_id <> '' AND s.parent_id = t.parent_id, false) OR (len(list_intersect(s.tags, t.tags)) > 0 AND s.type = t.type) THEN 'sibling' WHEN t.is_money_page THEN 'money' ELSE 'other' END AS role
  FROM sc WHERE allowed AND score >= 0.4 AND NOT (both_lang AND s.lang <> t.lang AND f_semantic < 0.18)){_anchors("ev0")},
ev AS (SELECT ev0.*, texts FROM ev0 JOIN (SELECT src, tgt, list(text ORDER BY place) AS texts FROM an GROUP BY 1, 2) USING (src, tgt)),
items AS (SELECT src, tgt, url, budget, list_transform(texts, lambda x: lower(x)) AS low, row_number() OVER (PARTITION BY src ORDER BY round(score, 9) DESC, rank) AS k FROM ev),
walk AS (
  SELECT DISTINCT src, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS tgt, CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS urls, CAST([] AS VARCHAR[]) AS used, false AS fits FROM items
  UNION ALL
  SELECT src, k, tgt, CASE WHEN fits THEN n + 1 ELSE n END, CASE WHEN fits THEN list_append(urls, url) ELSE urls END, CASE WHEN fits THEN list_concat(used, low) ELSE used END, fits FROM (
    SELECT w.src, i.k, i.tgt, w.n, w.urls, w.used, i.url, i.low, w.n < i.budget AND NOT list_contains(w.urls, i.url) AND len(list_intersect(w.used, i.low)) = 0 AS fits FROM walk w JOIN items i ON i.src = w.src AND i.k = w.k + 1)),
picked AS (SELECT src, tgt, n FROM walk WHERE fits)
"""

SQL = {
    "tokenize_counts": _BASE + "SELECT page_id, len(title_tokens) AS title_tokens, len(body_tokens) AS body_tokens, n_words FROM p",
    "term_frequency": _BASE + "SELECT field, page_id, term, tf FROM post",
    "term_document_frequency": _BASE + "SELECT field, term, df FROM df",
    "corpus_statistics": _BASE + "SELECT n, round(title_avg, 6) AS title_avg, round(body_avg, 6) AS body_avg FROM st",
    "bm25_idf": _BASE + "SELECT field, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df CROSS JOIN st",
    "body_norms": _BASE + "SELECT page_id, round(norm, 6) AS norm FROM norm",
    "pair_relevance": _BASE + "SELECT src, tgt, round(title_bm25, 6) AS title_bm25, round(body_bm25, 6) AS body_bm25, round(cosine, 6) AS cosine, round(entity, 6) AS entity, round(tag, 6) AS tag, entity_name, entity_type FROM ca",
    "bm25_title_topk": _BASE + "SELECT src, tgt, row_number() OVER (PARTITION BY src ORDER BY round(title_bm25, 6) DESC, tgt) AS place, round(title_bm25, 6) AS title_bm25 FROM pr WHERE title_bm25 > 0 QUALIFY place <= 10",
    "bm25_body_topk": _BASE + "SELECT src, tgt, row_number() OVER (PARTITION BY src ORDER BY round(body_bm25, 6) DESC, tgt) AS place, round(body_bm25, 6) AS body_bm25 FROM pr WHERE body_bm25 > 0 QUALIFY place <= 10",
    "taxonomy_overlap": _BASE + "SELECT * FROM (SELECT src, tgt, round(CASE WHEN len(s.taxonomy) > 0 AND len(t.taxonomy) > 0 THEN len(list_distinct(list_intersect(s.taxonomy, t.taxonomy))) * 1.0 / greatest(len(s.taxonomy), len(t.taxonomy)) ELSE 0 END, 6) AS taxonomy FROM ca) WHERE taxonomy > 0",
    "business_filter": _BASE + "SELECT src, tgt FROM ca WHERE business",
    "allow_candidates": _BASE + "SELECT src, tgt FROM ca WHERE allowed",
    "pair_factors": _BASE + """
SELECT src, tgt, CAST(language AS DOUBLE) AS language, CAST(review AS DOUBLE) AS review, CASE WHEN t.is_pillar OR t.type IN ('category', 'pillar') THEN 'intro' WHEN t.is_conversion_page THEN 'body' WHEN t.is_reference THEN 'conclusion' ELSE 'body' END AS placement,
  CASE WHEN t.is_pillar OR t.is_hub OR (len(t.taxonomy) > 0 AND s.taxonomy[1:len(t.taxonomy)] = t.taxonomy) THEN 'parent'
    WHEN coalesce(s.parent_id <> '' AND s.parent_id = t.parent_id, false) OR (len(list_intersect(s.tags, t.tags)) > 0 AND s.type = t.type) THEN 'sibling' WHEN t.is_money_page THEN 'money' ELSE 'other' END AS role,
  array_to_string(list_filter([CASE WHEN both_lang AND s.lang <> t.lang THEN 'lang_mismatch' END, CASE WHEN t.type = 'product' AND len(t.body_tokens) < 250 THEN 'thin_target' END,
    CASE WHEN list_contains(s.outbound_links, t.url) THEN 'dup_anchor' END], lambda x: x IS NOT NULL), ',') AS flags FROM ca""",
    "recall_candidates": _BASE + "SELECT src, tgt, round(recall, 6) AS recall FROM c",
    "features_wide": _BASE + "SELECT src, tgt, " + ", ".join(f"round(CAST({k} AS DOUBLE), 6) AS {k}" for k in _FEATURES) + " FROM ft",
    "score_pairs": _BASE + "SELECT src, tgt, round(score, 6) AS score FROM sc",
    "reason_text": _BASE + _REASONS + "SELECT * FROM reasons",
    "link_budgets": _BASE + "SELECT page_id, CAST(least(3 + greatest(n_words, 1) // 500, 12) AS BIGINT) AS budget FROM p",
    "inferred_entities": _BASE + "SELECT page_id, unnest(range(len(names))) AS pos, unnest(names) AS name FROM inferred",
    "anchor_select": _BASE + _anchors("c") + "SELECT src, tgt, place, text, start_off, end_off, variant FROM an",
    "suggestions": _BASE + _CHOICE + """
SELECT w.src, w.n AS place, e.url AS target_url, reason, round(score, 6) AS score, array_to_string(texts, '|') AS anchors, placement AS placement_hint, 'follow' AS rel, array_to_string(flags, ',') AS risk_flags, role
FROM picked w JOIN ev e USING (src, tgt) JOIN reasons USING (src, tgt)""",
    "suggestions_tsv": _BASE + _CHOICE + "SELECT printf('%.2f', score) || chr(9) || e.url || chr(9) || '[' || array_to_string(texts, ', ') || ']' AS value FROM picked w JOIN ev e USING (src, tgt)",
    "suggestion_inbound": _BASE + _CHOICE + "SELECT page_id, count(w.src) AS inbound FROM p LEFT JOIN picked w ON w.tgt = page_id GROUP BY 1",
    "suggestion_variants": _BASE + _CHOICE + "SELECT variant, count(*) AS n FROM picked JOIN an USING (src, tgt) GROUP BY 1",
    "dry_run_metrics": _BASE + _CHOICE + """,
kinds AS (SELECT variant, count(*) AS n FROM picked JOIN an USING (src, tgt) GROUP BY 1),
shape AS (SELECT page_id, coalesce(any_value(click_depth), 3) AS depth, count(w.src) AS inbound FROM p LEFT JOIN picked w ON w.tgt = page_id GROUP BY 1)
SELECT round((SELECT count(DISTINCT src) FROM picked) / (SELECT n FROM st), 6) AS coverage, round((SELECT avg(CASE WHEN inbound = 0 THEN 1.0 ELSE 0.0 END) FROM shape), 6) AS orphan_rate,
  round((SELECT avg(CASE WHEN inbound > 0 THEN greatest(1.0, depth - 0.5 * inbound) ELSE depth END) FROM shape), 6) AS avg_click_depth_after,
  round((SELECT CASE WHEN count(*) > 1 THEN -sum(n / t * ln(n / t)) / ln(count(*)) ELSE 0 END FROM kinds CROSS JOIN (SELECT sum(n) AS t FROM kinds)), 6) AS anchor_diversity_index,
  round((SELECT sum(r) FROM (SELECT count(*) - count(DISTINCT tgt) AS r FROM picked GROUP BY src)) / (SELECT n FROM st), 6) AS dup_target_rate,
  round((SELECT avg(score) FROM picked JOIN ev USING (src, tgt)), 6) AS mean_score_selected, round((SELECT avg(score) FROM ev ANTI JOIN picked USING (src, tgt)), 6) AS mean_score_rejected,
  round((SELECT avg(CASE WHEN list_contains(flags, 'lang_mismatch') THEN 1.0 ELSE 0.0 END) FROM picked JOIN ev USING (src, tgt)), 6) AS language_mismatch_rate,
  (SELECT '{' || string_agg('"' || variant || '":' || n, ',' ORDER BY variant) || '}' FROM kinds) AS anchor_variant_counts""",
}
