"""Evaluation passages in a corpus: a prefix-filtered set join.

A passage is ``window`` consecutive words of an item's field.  As a set of
shingles (runs of ``size`` words) a contained window needs every shingle, so one
necessary prefix token is enough: its rarest, by document counts over the whole
corpus.  The steps:

1. One pass over the corpus keeps the places of the shingles that occur in some
   item (a sorted array of hashes, shipped to the tasks only while it stays
   under ``broadcast_rows``; beyond that all places go through a semi join).
2. Document counts of these shingles order each window's shingles by rarity.
   Windows with a shingle of count 0 are contained nowhere and leave.
3. Windows join the places of their rarest shingle.  The length bound (the text
   has a window's number of words from there) and the positional bound (the
   window starts at or after word 0) are join conditions.
4. Exact containment: all shingles of the window must stand at their own places
   of the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.llm.near_duplicates import _constants, _mix
from linkspark.workspace import materialise

RUN = re.compile(r"[^\W_]+")


class Places:
    """The hash of the run of ``size`` words that starts at each word of a text."""

    def __init__(self, size: int) -> None:
        import xxhash

        self.size, self.digest, self.seen = size, xxhash.xxh64_intdigest, {}
        self.factors = _constants(size, 19) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = RUN.findall(text.lower()) if text else []
        n = len(words) - self.size + 1
        if n < 1:
            return np.zeros(0, np.uint64)
        seen, digest = self.seen, self.digest
        if len(seen) > 500_000:
            seen.clear()
        for w in set(words).difference(seen):
            seen[w] = digest(w)
        codes = np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        total = codes[:n] * self.factors[0]
        for k in range(1, self.size):
            total += codes[k : k + n] * self.factors[k]
        return _mix(total)


def _placer(size: int, wanted: np.ndarray | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(size)
        heads = None
        if wanted is not None:
            # a bitmap of the hashes' low 20 bits rules most places out before the binary search
            heads = np.zeros(1 << 20, bool)
            heads[(wanted & np.uint64(0xFFFFF)).astype(np.int64)] = True
        for batch in batches:
            ids, lengths, at, found = [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                codes = places(text.as_py())
                if not len(codes):
                    continue
                if wanted is None:
                    where = np.arange(len(codes))
                else:
                    where = np.flatnonzero(heads[(codes & np.uint64(0xFFFFF)).astype(np.int64)])
                    if len(where):
                        slot = np.minimum(np.searchsorted(wanted, codes[where]), len(wanted) - 1)
                        where = where[wanted[slot] == codes[where]]
                if len(where):
                    ids.append(np.full(len(where), doc, np.int64))
                    lengths.append(np.full(len(where), len(codes) + size - 1, np.int32))
                    at.append(where.astype(np.int32))
                    found.append(codes[where].view(np.int64))
            flat = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
            yield pa.RecordBatch.from_arrays([flat(ids, np.int64), flat(lengths, np.int32), flat(at, np.int32), flat(found, np.int64)], ["doc", "words", "at", "code"])

    return run


_PLACES = "doc long, words int, at int, code long"


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, fields: list[str], window: int = 12, size: int = 5, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, n_windows): each document and item where at least ``window``
    consecutive words of one of the item's fields are consecutive words of the text,
    with the number of different windows found.  Words are lower-cased runs of letters
    and digits.

    Rows with a null id, and null, empty or shorter texts and fields, give nothing;
    repeated rows count once; ids are bigints.  Other columns are ignored; an empty
    table on either side gives an empty result."""
    spark = docs.sparkSession
    sides = [items.select(F.col(item_id).cast("long").alias("item"), F.lit(k).alias("field"), F.col(f).alias("t")) for k, f in enumerate(fields)]
    texts = sides[0]
    for s in sides[1:]:
        texts = texts.unionByName(s)
    texts = texts.where("item is not null and t is not null")
    parts = texts.select((F.col("item") * len(fields) + F.col("field")).alias("doc"), "t")
    grams = materialise(parts.mapInArrow(_placer(size, None), _PLACES).distinct(), "item-grams")
    per = window - size + 1
    codes = grams.select("code").distinct()
    n = codes.count()
    corpus = docs.select(F.col(doc_id).cast("long").alias("doc"), F.col(text).alias("t")).where("doc is not null and t is not null")
    if n <= broadcast_rows:
        wanted = np.sort(np.array([r[0] for r in codes.toLocalIterator()], np.int64).view(np.uint64))
        found = corpus.mapInArrow(_placer(size, wanted), _PLACES) if n else spark.createDataFrame([], _PLACES)
    else:
        found = corpus.mapInArrow(_placer(size, None), _PLACES).join(codes, "code", "left_semi").select("doc", "words", "at", "code")
    found = materialise(found.distinct(), "places")
    counts = found.select("doc", "code").distinct().groupBy("code").agg(F.count("*").alias("df"))

    # windows as rows (part, start, offset, code): an item of w words makes w - window + 1 of them
    spread = grams.select("doc", "words", "code", F.col("at"), F.explode(F.sequence(F.lit(0), F.lit(per - 1))).alias("off"))
    spread = spread.select(F.col("doc").alias("part"), (F.col("at") - F.col("off")).alias("start"), "off", "code", "words").where(f"start >= 0 and start + {window} <= words")
    ranked = spread.join(counts, "code").groupBy("part", "start").agg(F.min(F.struct("df", "code", "off")).alias("rare"), F.count("*").alias("known"), F.array_sort(F.collect_list(F.struct("off", "code"))).alias("all"))
    windows = ranked.where(f"known = {per}").select("part", "start", F.col("rare.code").alias("code"), F.col("rare.off").alias("off"), F.transform("all", lambda x: x["code"]).alias("codes"))
    # equal windows of several items share one row in the join
    shared = windows.groupBy("codes", "code", "off").agg(F.collect_set("part").alias("parts"))
    shared = materialise(shared.select(F.monotonically_increasing_id().alias("win"), "*"), "windows")
    starts = found.join(shared.select("win", "code", "off"), "code").where(f"at - off >= 0 and at - off + {window} <= words").select("doc", "win", (F.col("at") - F.col("off")).alias("start"))
    need = starts.join(shared.select("win", F.posexplode("codes").alias("off", "code")), "win").select("doc", "win", "start", (F.col("start") + F.col("off")).alias("at"), "code")
    whole = need.join(found.select("doc", "at", "code"), ["doc", "at", "code"]).groupBy("doc", "win", "start").agg(F.count("*").alias("k")).where(f"k = {per}")
    hits = whole.select("doc", "win").distinct().join(shared.select("win", F.explode("parts").alias("part")), "win")
    return hits.groupBy(F.col("doc").alias("doc_id"), F.expr(f"part div {len(fields)}").alias("item_id")).agg(F.count("*").alias("n_windows"))
