"""Queries of the link table, sitemap, keyword-link and request operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linkspark.functions import text as X
from linkspark.functions import urls as U
from linkspark.functions.html_links import insert_links_udf, strip_links_udf
from linkspark.operators import keywords as K
from linkspark.operators import links as L
from linkspark.sources.sitemaps import parse_sitemaps, robots_text, sitemap_xml
from linkspark.sources.tables import table
from linkspark.streaming.throttle import admitted, client_ip, gated

LIMIT, WINDOW_S, WEEK_US = 60, 60, 604_800_000_000


def slug_from_url(spark, sf):
    links = L.slugged(table(spark, sf, "site_link").select("id", "url"))
    return links.select("id", "raw_slug", "slug", U.host(F.col("url")).alias("host"), U.origin(F.col("url")).alias("origin"))


def same_host_links(spark, sf):
    d = table(spark, sf, "site_domain").select(F.col("id").alias("domain_id"), U.host(F.col("base_url")).alias("base_host"))
    return table(spark, sf, "site_link").join(d, "domain_id").where(L.same_host(F.col("url"), F.col("base_host"))).select("id", "domain_id", "url")


def slug_map(spark, sf):
    return L.slug_map(table(spark, sf, "site_link"), ["domain_id"])


def upsert_links(spark, sf):
    """Late arrivals (later than a link's first row) are merged into the table by domain and url."""
    links = table(spark, sf, "site_link")
    first = Window.partitionBy("domain_id", "url").orderBy("created_at", "id")
    ranked = links.withColumn("n", F.row_number().over(first))
    merged = L.upsert_links(ranked.where("n = 1"), ranked.where("n > 1"), ["domain_id", "url"], ["slug", "raw_slug", "title", "id"], ["created_at"], "n")
    return merged.select("domain_id", "url", "slug", "raw_slug", "title", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def link_search(spark, sf):
    return L.search_links(table(spark, sf, "site_link"), "or", "1").select("id", "domain_id", "slug")


def link_counts(spark, sf):
    return L.link_counts(table(spark, sf, "site_link"))


def generation_history(spark, sf):
    rows = L.history(table(spark, sf, "link_generation"), table(spark, sf, "site_domain"))
    return rows.select("id", "user_id", "base_url", "shown", "made", F.size("priority_links").cast("long").alias("n_priority"), F.size("auto_links").cast("long").alias("n_auto"))


def insertion_totals(spark, sf):
    return table(spark, sf, "link_generation").select("id", *[c.cast("long") for c in L.generation_totals(F.col("inserted_records"))])


def missing_priority(spark, sf):
    return L.missing_priority(table(spark, sf, "link_generation"))


def sitemap_documents(spark, sf):
    """A sitemap for each domain, in blocks of at most 10,000 urls as the format's files have a bound."""
    w = Window.partitionBy("domain_id").orderBy("id")
    rows = table(spark, sf, "site_link").where("url is not null").select("domain_id", "id", "url").withColumn("part", F.floor((F.row_number().over(w) - 1) / 10_000))
    docs = rows.groupBy("domain_id", "part").agg(F.array_sort(F.collect_list(F.struct("id", "url"))).alias("u"))
    return docs.select(F.concat_ws("-", "domain_id", "part").alias("sitemap"), sitemap_xml(F.transform("u", lambda x: x["url"])).alias("xml"))


def sitemap_parse(spark, sf):
    found = parse_sitemaps(sitemap_documents(spark, sf), "sitemap", "xml")
    return found.select(F.col("id").alias("sitemap"), F.col("pos.at").cast("long").alias("at"), "url")


def robots_documents(spark, sf):
    return table(spark, sf, "site_domain").select("id", robots_text(F.col("base_url")).alias("robots"))


def _pair_texts(spark, sf) -> DataFrame:
    lines = F.array_join(F.transform("priority_pairs", lambda p: F.concat(p["term"], F.lit(" -> "), p["url"])), "\n")
    return table(spark, sf, "link_generation").select("id", lines.alias("pairs"))


def priority_pairs(spark, sf):
    return K.parse_pairs(_pair_texts(spark, sf), "id", "pairs").select("id", F.col("line_no").cast("long").alias("line_no"), "term", "url", "error")


def _docs(spark, sf) -> DataFrame:
    return table(spark, sf, "link_generation").select("id", F.coalesce("domain_id", F.lit(-1)).alias("scope"), F.coalesce("source_excerpt", F.lit("")).alias("text"), F.col("max_links").cast("int").alias("max_links"))


def _slugs(spark, sf, shared: bool = True) -> DataFrame:
    """Slugs and page titles by site; ``shared`` adds those of all sites as scope -1."""
    links = table(spark, sf, "site_link")
    own = L.slug_map(links, ["domain_id"]).withColumnRenamed("domain_id", "scope")
    every = own.unionByName(L.slug_map(links).withColumn("scope", F.lit(-1).cast("long"))) if shared else own
    # page titles up to their colon, which texts do hold; scope -1 is for texts without a site
    names = table(spark, sf, "page").select("domain_id", X.strip(F.regexp_extract("title", "^[^:：]*", 0)).alias("slug"), "url").where("slug <> '' and url is not null")
    scope = F.explode(F.array("domain_id", F.lit(-1).cast("long"))) if shared else F.col("domain_id")
    return every.unionByName(names.select(scope.alias("scope"), "slug", "url").groupBy("scope", "slug").agg(F.min("url").alias("url")))


def _terms(spark, sf) -> DataFrame:
    pairs = table(spark, sf, "link_generation").select("id", F.posexplode("priority_pairs").alias("pos", "p")).select("id", "pos", F.col("p.term").alias("term"), F.col("p.url").alias("url"))
    return K.term_dictionary(pairs, K.matching_slugs(_docs(spark, sf), _slugs(spark, sf)))


def keyword_matches(spark, sf):
    return K.matching_slugs(_docs(spark, sf), _slugs(spark, sf))


def keyword_dictionary(spark, sf):
    """The whole dictionary of every site: its slugs, longest first."""
    slugs = L.slug_map(table(spark, sf, "site_link"), ["domain_id"]).withColumnRenamed("domain_id", "id")
    none = spark.createDataFrame([], "id long, pos int, term string, url string")
    return K.term_dictionary(none, slugs).select("id", F.col("rank").cast("long").alias("rank"), "key", "term", "url", "priority")


def plain_text_links(spark, sf):
    return K.link_paragraphs(_docs(spark, sf), _terms(spark, sf)).select("id", "html", F.size("inserted").cast("long").alias("n"), F.to_json("inserted").alias("inserted"))


def html_keyword_links(spark, sf):
    """Pages' html with links for their site's slugs that occur in their text."""
    docs = table(spark, sf, "page").select(F.col("page_id").alias("id"), F.col("domain_id").alias("scope"), F.coalesce("text", F.lit("")).alias("text"), "html")
    terms = K.term_dictionary(spark.createDataFrame([], "id long, pos int, term string, url string"), K.matching_slugs(docs.drop("html"), _slugs(spark, sf, False)))
    lists = terms.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "term", "url", "priority"))).alias("terms"))
    made = docs.join(lists, "id", "left").select("id", insert_links_udf("html", "terms", F.lit(10)).alias("r"))
    return made.select(F.col("id").alias("page_id"), "r.html", F.size("r.inserted").cast("long").alias("n"))


def strip_links(spark, sf):
    return table(spark, sf, "page").select("page_id", strip_links_udf("html").alias("html"))


def paragraph_wrap(spark, sf):
    return table(spark, sf, "page").select("page_id", X.paragraph_html(F.col("text")).alias("html"))


def title_terms(spark, sf):
    t = X.strip(F.coalesce("title", F.lit("")))
    return table(spark, sf, "page").select("page_id", X.head_terms(t).alias("head"), X.tail_terms(t).alias("tail"), X.normal_term(F.coalesce("title", F.lit(""))).alias("normal"))


def query_parameters(spark, sf):
    return table(spark, sf, "page").select("page_id", F.array_join(U.parameter_names(F.col("url")), ",").alias("names"), U.tracking_only(F.col("url")).alias("tracking"))


def request_clients(spark, sf):
    """Requests by client: deliveries of one hit count once, by the first received."""
    hits = _hits(spark, sf)
    return hits.groupBy("route", "ip").agg(F.count("*").alias("n"))


def _hits(spark, sf) -> DataFrame:
    raw = gated(table(spark, sf, "request_hit"))
    once = raw.groupBy("hit_id").agg(F.min(F.struct("received_at", "ts", "route", "forwarded_for", "remote_addr")).alias("h"))
    return once.select("hit_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', h.ts)").alias("us"), "h.route", client_ip(F.col("h.forwarded_for"), F.col("h.remote_addr")).alias("ip"))


def rate_limit(spark, sf):
    done = admitted(_hits(spark, sf), ["route", "ip"], ["us", "hit_id"], LIMIT, WINDOW_S * 1_000_000)
    return done.select("hit_id", "route", "ip", "admitted")


def rate_limit_tight(spark, sf):
    """The same with a hit a week, so that a good part of sparse traffic is refused."""
    done = admitted(_hits(spark, sf), ["route", "ip"], ["us", "hit_id"], 1, WEEK_US)
    return done.select("hit_id", "route", "ip", "admitted")


QUERIES = {f.__name__: f for f in (
    slug_from_url, same_host_links, slug_map, upsert_links, link_search, link_counts, generation_history, insertion_totals, missing_priority, sitemap_documents, sitemap_parse, robots_documents, priority_pairs,
    keyword_matches, keyword_dictionary, plain_text_links, html_keyword_links, strip_links, paragraph_wrap, title_terms, query_parameters, request_clients, rate_limit, rate_limit_tight)}

WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_SYNTAX = r"'^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?'"
_RAW = "list_extract(string_split(regexp_replace(regexp_extract({0}, " + _SYNTAX + ", 3), '/+$', ''), '/'), -1)"
_HOST = "nullif(lower(regexp_replace(regexp_replace(regexp_extract({0}, " + _SYNTAX + ", 2), '^.*@', ''), ':[0-9]*$', '')), '')"


def _at(template: str, x: str) -> str:
    return template.replace("{0}", x)


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _collapse(x: str) -> str:
    return f"regexp_replace({_strip(x)}, '{WS}+', ' ', 'g')"


_HITS = """
WITH RECURSIVE g AS (SELECT hit_id, arg_min({'ts': ts, 'route': route, 'f': forwarded_for, 'r': remote_addr}, {'a': received_at, 'b': ts, 'c': route, 'd': coalesce(forwarded_for, ''), 'e': coalesce(remote_addr, '')}) AS h
  FROM request_hit WHERE upper(method) IN ('GET', 'POST') AND route IS NOT NULL GROUP BY 1),
hits AS (SELECT hit_id, epoch_us(h.ts) AS us, h.route AS route, CASE WHEN h.f IS NOT NULL THEN trim(split_part(h.f, ',', 1), ' ') ELSE coalesce(h.r, '0.0.0.0') END AS ip FROM g)"""


def _limited(limit: int, window_us: int) -> str:
    return _HITS + f""",
n AS (SELECT *, row_number() OVER (PARTITION BY route, ip ORDER BY us, hit_id) AS k FROM hits),
walk AS (
  SELECT hit_id, route, ip, k, true AS admitted, [us] AS live FROM n WHERE k = 1
  UNION ALL
  SELECT n.hit_id, n.route, n.ip, n.k, len(list_filter(w.live, lambda x: x > n.us - {window_us})) < {limit},
    CASE WHEN len(list_filter(w.live, lambda x: x > n.us - {window_us})) < {limit} THEN list_append(list_filter(w.live, lambda x: x > n.us - {window_us}), n.us) ELSE list_filter(w.live, lambda x: x > n.us - {window_us}) END
  FROM walk w JOIN n ON n.route = w.route AND n.ip = w.ip AND n.k = w.k + 1)
SELECT hit_id, route, ip, admitted FROM walk"""


_TITLE_WORDS = f"list_filter(string_split_regex(t, '{WS}+'), lambda x: x <> '')"
SQL = {
    "slug_from_url": f"SELECT id, {_at(_RAW, 'url')} AS raw_slug, lower(translate({_at(_RAW, 'url')}, '-_', '  ')) AS slug, {_at(_HOST, 'url')} AS host, CASE WHEN regexp_extract(url, {_SYNTAX}, 1) <> '' AND regexp_extract(url, {_SYNTAX}, 2) <> '' THEN regexp_extract(url, {_SYNTAX}, 1) || '://' || regexp_extract(url, {_SYNTAX}, 2) END AS origin FROM site_link",
    "same_host_links": f"SELECT l.id, domain_id, url FROM site_link l JOIN site_domain d ON d.id = domain_id WHERE {_at(_HOST, 'url')} IS NULL OR {_at(_HOST, 'url')} = {_at(_HOST, 'base_url')}",
    "slug_map": "SELECT domain_id, slug, arg_max(url, id) AS url FROM site_link WHERE slug IS NOT NULL GROUP BY 1, 2",
    "upsert_links": """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY domain_id, url ORDER BY created_at, id) AS n, row_number() OVER (PARTITION BY domain_id, url ORDER BY created_at DESC, id DESC) AS m FROM site_link)
SELECT a.domain_id, a.url, b.slug, b.raw_slug, b.title, strftime(a.created_at, '%Y-%m-%d %H:%M:%S') AS created_at
FROM r a JOIN r b ON a.domain_id IS NOT DISTINCT FROM b.domain_id AND a.url IS NOT DISTINCT FROM b.url AND a.n = 1 AND b.m = 1""",
    "link_search": "SELECT id, domain_id, slug FROM site_link WHERE domain_id = 1 AND (contains(lower(slug), 'or') OR contains(lower(raw_slug), 'or') OR contains(lower(title), 'or'))",
    "link_counts": "SELECT domain_id, count(*) AS n_links FROM site_link GROUP BY 1",
    "generation_history": """
SELECT g.id, user_id, base_url, CASE WHEN length(source_excerpt) > 240 THEN substr(source_excerpt, 1, 239) || '…' ELSE source_excerpt END AS shown, strftime(g.created_at, '%b %-d, %Y %H:%M') AS made,
  len(list_filter(inserted_records, lambda r: r.priority)) AS n_priority, len(list_filter(inserted_records, lambda r: NOT r.priority)) AS n_auto
FROM link_generation g LEFT JOIN site_domain d ON d.id = domain_id""",
    "insertion_totals": "SELECT id, coalesce(len(inserted_records), 0) AS inserted_total, coalesce(len(list_filter(inserted_records, lambda r: r.priority)), 0) AS inserted_priority, coalesce(len(list_filter(inserted_records, lambda r: NOT r.priority)), 0) AS inserted_auto FROM link_generation",
    "missing_priority": f"""
WITH a AS (SELECT id, unnest(priority_pairs).term AS term FROM link_generation), b AS (SELECT id, unnest(inserted_records) AS r FROM link_generation)
SELECT DISTINCT id, term FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.id = a.id AND r.priority AND lower({_collapse('r.term')}) = lower({_collapse('a.term')}))""",
    "sitemap_parse": "WITH n AS (SELECT domain_id, id, url, row_number() OVER (PARTITION BY domain_id ORDER BY id) - 1 AS k FROM site_link WHERE url IS NOT NULL) SELECT concat_ws('-', domain_id, k // 10000) AS sitemap, k % 10000 AS at, trim(url) AS url FROM n",
    "robots_documents": "SELECT id, 'User-agent: *' || chr(10) || 'Allow: /' || chr(10) || 'Sitemap: ' || regexp_replace(base_url, '/+$', '') || '/sitemap.xml' || chr(10) AS robots FROM site_domain",
    "keyword_matches": f"""
WITH d AS (SELECT id, coalesce(domain_id, -1) AS scope, coalesce(source_excerpt, '') AS text FROM link_generation),
t AS (SELECT domain_id, {_strip("regexp_extract(title, '^[^:：]*')")} AS slug, url FROM page WHERE url IS NOT NULL),
s AS (SELECT domain_id AS scope, slug, arg_max(url, id) AS url FROM site_link WHERE slug IS NOT NULL GROUP BY 1, 2 UNION ALL SELECT -1, slug, arg_max(url, id) FROM site_link WHERE slug IS NOT NULL GROUP BY 2
  UNION ALL SELECT domain_id, slug, min(url) FROM t WHERE slug <> '' GROUP BY 1, 2 UNION ALL SELECT -1, slug, min(url) FROM t WHERE slug <> '' GROUP BY 2)
SELECT DISTINCT d.id, s.slug, s.url FROM d JOIN s USING (scope) WHERE {_collapse('slug')} <> '' AND contains(lower(text), lower({_collapse('slug')}))
  AND regexp_matches(lower(text), '(^|[^A-Za-z0-9_])' || regexp_escape(lower({_collapse('slug')})) || '([^A-Za-z0-9_]|$)')""",
    "keyword_dictionary": f"""
WITH m AS (SELECT domain_id AS id, {_collapse('slug')} AS term, arg_max(url, id) AS url FROM site_link WHERE slug IS NOT NULL GROUP BY 1, slug),
k AS (SELECT *, lower(term) AS key, row_number() OVER (PARTITION BY id, lower(term) ORDER BY -length(term), term, url) AS n FROM m WHERE term <> '')
SELECT id, row_number() OVER (PARTITION BY id ORDER BY -length(term), term) AS rank, key, term, url, false AS priority FROM k WHERE n = 1""",
    "strip_links": None,
    "paragraph_wrap": f"SELECT page_id, array_to_string(list_transform(list_filter(list_transform(string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'), lambda x: {_strip('x')}), lambda x: x <> ''), lambda x: '<p>' || x || '</p>'), '') AS html FROM page",
    "title_terms": f"""
WITH a AS (SELECT page_id, {_strip("coalesce(title, '')")} AS t FROM page)
SELECT page_id, CASE WHEN len({_TITLE_WORDS}) <= 4 THEN t ELSE array_to_string({_TITLE_WORDS}[1:4], ' ') END AS head, CASE WHEN len({_TITLE_WORDS}) <= 4 THEN t ELSE array_to_string({_TITLE_WORDS}[-3:], ' ') END AS tail, lower({_collapse('t')}) AS normal FROM a""",
    "query_parameters": f"""
WITH a AS (SELECT page_id, url, list_transform(list_filter(string_split(regexp_extract(url, {_SYNTAX}, 4), '&'), lambda x: regexp_matches(x, '^[^=]*=.')), lambda x: lower(split_part(x, '=', 1))) AS n FROM page)
SELECT page_id, array_to_string(n, ',') AS names, contains(url, '?') AND len(list_filter(n, lambda x: NOT (x LIKE 'utm%' OR x LIKE 'ref%' OR x = 'replytocom'))) = 0 AS tracking FROM a""",
    "request_clients": _HITS + " SELECT route, ip, count(*) AS n FROM hits GROUP BY 1, 2",
    "rate_limit": _limited(LIMIT, WINDOW_S * 1_000_000),
    "rate_limit_tight": _limited(1, WEEK_US),
    "priority_pairs": f"""
WITH a AS (SELECT id, generate_subscripts(priority_pairs, 1) AS line_no, unnest(priority_pairs) AS p FROM link_generation),
b AS (SELECT id, line_no, {_strip('p.term')} AS term, {_strip('p.url')} AS url FROM a WHERE p.term IS NOT NULL AND p.url IS NOT NULL)
SELECT id, line_no, term, CASE WHEN regexp_matches(url, '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN url ELSE 'http://' || url END AS url, CAST(NULL AS VARCHAR) AS error
FROM b QUALIFY row_number() OVER (PARTITION BY id, lower(term) ORDER BY line_no) = 1""",
}
SQL = {k: v for k, v in SQL.items() if v}
