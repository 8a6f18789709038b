"""Keyword links: priority pairs, the term dictionary and insertion into plain paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkspark.functions import text as X
from linkspark.functions.html_links import LINK_CLASS

SEPARATORS = ["->", "|", ",", "\t"]
URL = r"(?iu)^(?:[a-z][a-z0-9+.\-]*://)?(?:[^\s/?#@]+@)?(?:localhost|[\p{L}\p{N}_\-]+(?:\.[\p{L}\p{N}_\-]+)+|\d+(?:\.\d+){3})(?::\d{1,5})?(?:[/?#]\S*)?$"


def parse_pairs(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, line_no, term, url, error) of newline-separated ``keyword SEPARATOR url`` lines.

    A line is split at the first of ``->``, ``|``, ``,`` and tab that it holds, in this
    order.  Blank lines are skipped, of repeated terms (in any case) the first counts.
    A line without separator, term or valid url has an error that names the line, and
    neither term nor url; urls without scheme get ``http://``.  Null texts have no rows."""
    lines = rows.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, "\r\n|[\n\r]")).alias("at", "line"))
    lines = lines.select("id", (F.col("at") + 1).alias("line_no"), X.strip(F.col("line")).alias("line")).where("line <> ''")
    sep = F.lit(None).cast("string")
    for x in reversed(SEPARATORS):
        sep = F.when(F.contains(F.col("line"), F.lit(x)), x).otherwise(sep)
    at = F.instr(F.col("line"), F.col("sep"))
    parts = lines.withColumn("sep", sep).withColumns({"term": X.strip(F.substring("line", F.lit(1), at - 1)), "url": X.strip(F.substring(F.col("line"), at + F.length("sep"), F.length("line")))})
    full = F.when(F.col("url").rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://"), F.col("url")).otherwise(F.concat(F.lit("http://"), F.col("url")))
    where = F.concat(F.lit("Priority line "), F.col("line_no").cast("string"))
    error = F.when(F.col("sep").isNull(), F.concat(where, F.lit(" must include a keyword and a url"))).when(F.col("term") == "", F.concat(where, F.lit(" is missing a keyword"))).when(~F.col("url").rlike(URL), F.concat(where, F.lit(" has an invalid url")))
    parts = parts.withColumn("error", error).withColumns({"url": F.when(F.col("error").isNull(), full), "term": F.when(F.col("error").isNull(), F.col("term"))})
    w = Window.partitionBy("id", F.lower("term")).orderBy("line_no")
    return parts.withColumn("n", F.row_number().over(w)).where("error is not null or n = 1").select("id", "line_no", "term", "url", "error")


def term_dictionary(pairs: DataFrame, slugs: DataFrame) -> DataFrame:
    """(id, rank, key, term, url, priority): each document's terms in the order they are tried.

    ``pairs(id, pos, term, url)`` come first by position, then ``slugs(id, slug, url)``,
    longer before shorter, then by text.  Of terms with one normal form the first counts."""
    a = pairs.select("id", X.collapse(F.col("term")).alias("term"), "url", F.lit(True).alias("priority"), F.lit(0).alias("g"), F.col("pos").cast("int").alias("o"))
    b = slugs.select("id", X.collapse(F.col("slug")).alias("term"), "url", F.lit(False).alias("priority"), F.lit(1).alias("g"), (-F.length(X.collapse(F.col("slug")))).alias("o"))
    every = a.unionByName(b).where("term <> ''").withColumn("key", F.lower("term"))
    first = every.groupBy("id", "key").agg(F.min(F.struct("g", "o", "term", "url", "priority")).alias("m"))
    w = Window.partitionBy("id").orderBy("m.g", "m.o", "m.term")
    return first.select("id", F.row_number().over(w).alias("rank"), "key", "m.term", "m.url", "m.priority")


#: What bounds a term, by the case rules that also hold inside term_pattern.
ASCII_WORD = "(?iu)([a-z0-9_]+)"
#: Numbers of leading characters by which the other terms are found, longest first.
REACH = [4, 2, 1]


def _folded(x: Column) -> Column:
    """One form of all strings that a pattern in any case takes for the same: upper case, after the
    six letters that it doesn't reach."""
    return F.upper(F.translate(x, "\u0130\u212a\u212b\u1e9e\u03f4\u2126", "ikåßθω"))


def term_heads(slugs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms with the ``head`` by which they meet texts: (scope, slug, url, head) of those with an ASCII word, the one
    that fewest terms of the scope have, and (scope, slug, url, reach, head) of the others, their first ``reach`` characters."""
    term = X.collapse(F.col("slug"))
    reach = F.coalesce(*[F.when(F.length(term) >= n, n) for n in REACH])
    own = F.array_distinct(F.transform(F.regexp_extract_all(term, F.lit(ASCII_WORD), 1), _folded))
    named = slugs.select("scope", "slug", "url", F.explode(own).alias("head")).withColumn("n", F.count("*").over(Window.partitionBy("scope", "head")))
    named = named.groupBy("scope", "slug", "url").agg(F.min(F.struct("n", -F.length("head"), "head"))["head"].alias("head"))
    other = slugs.where(F.size(own) == 0).select("scope", "slug", "url", reach.alias("reach"), _folded(F.substring(term, F.lit(1), reach)).alias("head")).where("head <> ''")
    return named, other


def matching_slugs(docs: DataFrame, slugs: DataFrame) -> DataFrame:
    """(id, slug, url) of the dictionary terms that a document's text holds.

    ``docs(id, scope, text)`` and ``slugs(scope, slug, url)`` meet by scope and one ASCII word of the
    term, then the whole term is looked for as a bounded phrase.  Bounds are ASCII word characters
    only: each ASCII word of a term is a whole ASCII word of any text that holds it, whatever
    letters touch it, so the word that fewest of the scope's terms have will do.  Terms without one may start
    anywhere, and meet texts by their first characters.  A dictionary of any size is thus never paired with every text."""
    term = X.collapse(F.col("slug"))
    named, other = term_heads(slugs)
    words = docs.select("id", "scope", F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(ASCII_WORD), 1), _folded))).alias("head"))
    # only the lengths that a scope's terms have are cut out of its texts
    reaches = other.groupBy("scope").agg(F.collect_set("reach").alias("reaches"))
    starts = F.flatten(F.array(*[F.when(F.array_contains("reaches", n), F.regexp_extract_all("text", F.lit(rf"(?isu)(?=([^a-z0-9_\s].{{{n - 1}}}))"), 1)).otherwise(F.array().cast("array<string>")) for n in REACH]))
    places = docs.where("text is not null").join(reaches, "scope").select("id", "scope", F.explode(F.array_distinct(F.transform(starts, _folded))).alias("head"))
    looks = lambda terms: terms.select("scope", "head", "slug", "url", F.lower(term).alias("low"), X.term_pattern(term).alias("pattern"))
    # scope and head meet as one short hash: what it lets pass besides fails the exact check, as the scope is compared there
    key = F.hash("scope", "head").alias("key")
    met = words.unionByName(places).select("id", key).join(looks(named).unionByName(looks(other)).withColumn("key", key), "key").select("id", F.col("scope").alias("of"), "slug", "url", "low", "pattern")
    held = docs.where("text is not null").select("id", "scope", "text").repartition("id").withColumn("in_lower", F.lower("text"))
    return met.join(held, "id").where((F.col("scope") == F.col("of")) & F.contains("in_lower", "low") & F.regexp_like("text", "pattern")).select("id", "slug", "url").distinct()


def link_paragraphs(docs: DataFrame, terms: DataFrame, max_links: int = 10) -> DataFrame:
    """(id, html, inserted) of ``docs(id, text)``: every non-blank line becomes a paragraph and gets at
    most one link, for the first unused term by rank that it holds as a bounded phrase.

    ``terms(id, rank, key, term, url, priority)`` need only hold terms that occur.  A column
    ``max_links`` of ``docs`` overrides the argument.  Null texts give empty html."""
    lists = terms.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("rank", "key", "term", "url", "priority", X.term_pattern(F.col("term")).alias("pattern")))).alias("terms"))
    cap = F.coalesce(F.col("max_links"), F.lit(max_links)).cast("int") if "max_links" in docs.columns else F.lit(max_links)
    df = docs.select("id", X.paragraphs(F.coalesce("text", F.lit(""))).alias("lines"), cap.alias("cap")).join(lists, "id", "left")
    record = "array<struct<term:string,url:string,priority:boolean,context:string>>"
    start = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("used"), F.array().cast(record).alias("ins"))

    def step(acc, line):
        open_ = F.filter(F.coalesce("terms", F.array().cast("array<struct<rank:int,key:string,term:string,url:string,priority:boolean,pattern:string>>")), lambda m: ~F.array_contains(acc["used"], m["key"]) & F.contains(F.lower(line), m["key"]) & F.regexp_like(line, m["pattern"]))
        m = F.when(F.size(acc["used"]) < F.col("cap"), F.get(open_, F.lit(0)))
        at = F.regexp_instr(line, m["pattern"]) - 1
        hit = F.substring(line, at + 1, F.length(F.regexp_substr(line, m["pattern"])))
        source = F.when(m["priority"], "priority").otherwise("auto")
        linked = F.concat(F.substring(line, F.lit(1), at), F.lit('<a href="'), F.replace(m["url"], F.lit('"'), F.lit("&quot;")), F.lit(f'" class="{LINK_CLASS}" data-source="'), source, F.lit('">'), hit, F.lit("</a>"), F.substring(line, at + F.length(hit) + 1, F.length(line)))
        made = F.struct(m["term"].alias("term"), m["url"].alias("url"), m["priority"].alias("priority"), X.snippet(line, at, at + F.length(hit)).alias("context"))
        return F.when(m["key"].isNotNull(), F.struct(F.array_append(acc["out"], linked).alias("out"), F.array_append(acc["used"], m["key"]).alias("used"), F.concat(acc["ins"], F.array(made).cast(record)).alias("ins"))).otherwise(
            F.struct(F.array_append(acc["out"], line).alias("out"), acc["used"].alias("used"), acc["ins"].alias("ins")))

    df = df.select("id", F.aggregate("lines", start, step).alias("r"))
    return df.select("id", F.array_join(F.transform("r.out", lambda x: F.concat(F.lit("<p>"), x, F.lit("</p>"))), "").alias("html"), F.col("r.ins").alias("inserted"))
