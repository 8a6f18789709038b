"""Sitemaps: fetching, decoding and parsing."""

from __future__ import annotations

import gzip
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Fetcher = Callable[[str, int], "tuple[bytes, str, str | None] | None"]


def http_fetch(url: str, timeout: int = 15) -> tuple[bytes, str, str | None] | None:
    """Body, content type and charset of a url; None on any error."""
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=timeout) as r:  # noqa: S310
            return r.read(), r.headers.get_content_type(), r.headers.get_content_charset()
    except Exception:  # noqa: BLE001
        return None


def decoded(data: bytes, name: str, kind: str = "", charset: str | None = None) -> str | None:
    """Text of a body: unpacked if the name or type says gzip (left as it is if that fails),
    as UTF-8, else by the given charset with replacement, else Latin-1."""
    if name.lower().endswith(".gz") or kind in ("application/x-gzip", "application/gzip"):
        try:
            data = gzip.decompress(data)
        except (OSError, EOFError):
            if charset is not None or kind:
                return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode(charset, "replace") if charset else data.decode("latin-1")


def fetch_sitemaps(urls: DataFrame, url_col: str, fetch: Fetcher = http_fetch, timeout: int = 15) -> DataFrame:
    """(url, xml): one fetch for each distinct url, spread over the tasks; null where it failed."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            xml = []
            for url in part["url"]:
                got = fetch(url, timeout)
                xml.append(decoded(got[0], url, got[1], got[2] or "utf-8") if got else None)
            yield pd.DataFrame({"url": part["url"], "xml": xml})

    return urls.select(F.col(url_col).alias("url")).where("url is not null").distinct().mapInPandas(run, "url string, xml string")


def read_uploads(spark, path: str) -> DataFrame:
    """(path, xml) of uploaded files, gzip or plain."""

    @F.pandas_udf("string")
    def text(names: pd.Series, data: pd.Series) -> pd.Series:
        return pd.Series([decoded(bytes(d), n) for n, d in zip(names, data)])

    return spark.read.format("binaryFile").load(path).select("path", text("path", "content").alias("xml"))


def sitemap_source(upload: Column, sitemap_url: Column, base_url: Column) -> Column:
    """Where a sitemap comes from: an uploaded file, else its url, else the site's default place."""
    return F.coalesce(upload, F.nullif(sitemap_url, F.lit("")), F.concat(F.regexp_replace(base_url, "/+$", ""), F.lit("/sitemap.xml")))


def _locations(texts: pa.Array) -> tuple[list, list]:
    from xml.etree import ElementTree

    kinds, found = [], []
    for text in texts:
        kind, locs = False, []
        try:
            root = ElementTree.fromstring((text.as_py() or "").strip().encode()) if text.is_valid else None
            if root is not None:
                kind = root.tag.lower().endswith("sitemapindex")
                locs = [e.text.strip() for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == "loc" and e.text and e.text.strip()]
        except (ElementTree.ParseError, ValueError):
            locs = []
        kinds.append(kind)
        found.append(locs)
    return kinds, found


def parse_sitemaps(sitemaps: DataFrame, id_col: str, xml_col: str, children: DataFrame | None = None) -> DataFrame:
    """(id, pos, url): the locations of each sitemap in order, of any namespace, trimmed.

    An index takes the locations of its children from ``children(url, xml)``, one level
    deep; without ``children`` its own.  Null, empty and malformed XML gives no rows."""
    columns = ["id", "is_index", "locs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds, locs = _locations(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(kinds, pa.bool_()), pa.array(locs, pa.list_(pa.string()))], columns)

    kind = dict(sitemaps.dtypes)[id_col]
    rows = sitemaps.select(F.col(id_col).alias("id"), F.col(xml_col).alias("xml")).mapInArrow(run, f"id {kind}, is_index boolean, locs array<string>")
    own = rows.where("not is_index" if children is not None else "true").select("id", F.lit(0).alias("part"), F.posexplode("locs").alias("at", "url"))
    if children is not None:
        inner = children.select(F.col("url").alias("child"), F.col("xml").alias("xml")).groupBy("child").agg(F.max("xml").alias("xml")).mapInArrow(run, "id string, is_index boolean, locs array<string>")
        index = rows.where("is_index").select("id", F.posexplode("locs").alias("part", "child"))
        own = own.unionByName(index.join(inner.select(F.col("id").alias("child"), "locs"), "child").select("id", "part", F.posexplode("locs").alias("at", "url")))
    return own.select("id", F.struct("part", "at").alias("pos"), "url")


def sitemap_xml(urls: Column) -> Column:
    """A urlset document of an array of urls."""
    safe = F.transform(urls, lambda u: F.replace(F.replace(F.replace(u, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")))
    body = F.array_join(F.transform(safe, lambda u: F.concat(F.lit("<url><loc>"), u, F.lit("</loc></url>"))), "")
    return F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">'), body, F.lit("</urlset>"))


def robots_text(base_url: Column) -> Column:
    return F.concat(F.lit("User-agent: *\nAllow: /\nSitemap: "), F.regexp_replace(base_url, "/+$", ""), F.lit("/sitemap.xml\n"))
