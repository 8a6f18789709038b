"""Near-duplicate texts by b-bit MinHash.

One pass over the texts makes, for each, the minima of ``BANDS * ROWS`` hash
functions over its set of word shingles.  Bands of full minima become bucket
keys; of each minimum only the ``BITS`` low bits are retained and packed into
64-bit words.  Texts in a common bucket are candidates.  From the packed words
the share E of equal low bits is counted with xor and bit counts, and corrected
for chance agreement, J ~ (E - 2^-b) / (1 - 2^-b).  Pairs whose estimate is near
or above the threshold are then decided exactly on their shingle sets.

Texts with equal shingle sets collapse into one representative before the
bands, so a group of copies costs one row whatever its size.  With 48 bands of 5
rows a pair at J = 0.7 is missed with probability 1.5e-4, one at 0.75 with 2e-6.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkspark.workspace import discard, materialise

BANDS, ROWS, BITS = 48, 5, 4
#: Characters that are words of their own: kana, Han and Thai.
SOLO = "぀-ヿ㐀-鿿฀-๿"
WORD = re.compile(rf"[{SOLO}]|[^\s{SOLO}]+")
BLOCK = 1 << 15


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _constants(n: int, seed: int) -> np.ndarray:
    return _mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Shingler:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words of a text."""

    def __init__(self, size: int = 5) -> None:
        import xxhash

        self.size, self.digest, self.seen = size, xxhash.xxh64_intdigest, {}
        self.factors = _constants(size, 7) | np.uint64(1)

    def __call__(self, text: str | None) -> np.ndarray:
        words = WORD.findall(text.lower()) if text else []
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
        return np.unique(_mix(total))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))


def _sketcher(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingles, k = Shingler(size), BANDS * ROWS
        factors = (_constants(k, 11) | np.uint64(1)).astype(np.uint32)[:, None]
        twists = _constants(k, 13).astype(np.uint32)[:, None]
        per = 64 // BITS
        places = (np.arange(per, dtype=np.uint64) * np.uint64(BITS))[None, :]
        weights = _constants(ROWS, 17)[None, :] | np.uint64(1)
        for batch in batches:
            ids, marks, sigs, keys, counts = [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = shingles(text.as_py())
                if not len(found):
                    continue
                low = found.astype(np.uint32)[None, :]
                minima = np.full(k, 0xFFFFFFFF, np.uint32)
                for at in range(0, low.shape[1], BLOCK):
                    np.minimum(minima, (((low[:, at : at + BLOCK] ^ twists) * factors)).min(axis=1), out=minima)
                wide = minima.astype(np.uint64)
                kept = (wide & np.uint64((1 << BITS) - 1)).reshape(-1, per)
                sigs.append(np.bitwise_or.reduce(kept << places, axis=1))
                keys.append(_mix((_mix(wide.reshape(BANDS, ROWS)) * weights).sum(axis=1, dtype=np.uint64)))
                marks.append(xxhash.xxh3_128_digest(found.tobytes()))
                ids.append(doc)
                counts.append(len(found))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(marks, pa.binary()), pa.array(counts, pa.int32()), _lists(sigs), _lists(keys)], ["id", "mark", "n", "sig", "bands"])

    return run


def _shingle_lists(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingler(size)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingles(t.as_py()) for t in batch.column(1)])], ["id", "s"])

    return run


def estimate(a: str, b: str) -> str:
    """SQL of the collision-corrected similarity of two packed signatures."""
    ones = sum(1 << (BITS * k) for k in range(64 // BITS))
    ones -= (1 << 64) if ones >= 1 << 63 else 0
    folded = "|".join(f"shiftrightunsigned(x, {k})" if k else "x" for k in range(BITS))
    differ = f"aggregate(zip_with({a}, {b}, (p, q) -> p ^ q), 0, (acc, x) -> acc + bit_count(({folded}) & {ones}L))"
    chance = 1 / (1 << BITS)
    return f"((1 - {differ} / {BANDS * ROWS}D - {chance}D) / {1 - chance}D)"


def near_duplicates(docs: DataFrame, id_col: str, text_col: str, threshold: float = 0.8, size: int = 5, slack: float = 0.15) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``: ``links(a, b, jaccard)`` with a < b for each pair of
    different shingle sets with Jaccard similarity of at least ``threshold`` that
    meets in a bucket; ``members(rep, id)`` for each text its set's representative.

    ``id_col`` is a bigint and unique; a row with a null id, or whose text is null or has fewer than
    ``size`` words, has no shingles and appears in neither.  Whole texts count,
    of any length.  ``slack`` is the margin of the estimate below the threshold,
    some five standard deviations.  Other columns are ignored; an empty table gives
    empty results."""
    pages = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    sketch = materialise(pages.mapInArrow(_sketcher(size), "id long, mark binary, n int, sig array<long>, bands array<long>"), "sketch")
    marks = sketch.groupBy("mark").agg(F.min("id").alias("rep"))
    members = materialise(sketch.select("id", "mark").join(marks, "mark").select("rep", "id").distinct(), "copies")
    reps = sketch.join(members.where("rep = id").select("id"), "id", "left_semi")
    buckets = reps.select("id", F.posexplode("bands").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("key"))
    met = buckets.select("key", F.col("id").alias("a")).join(buckets.select("key", F.col("id").alias("b")), "key").where("a < b").select("a", "b").distinct()
    left = reps.select(F.col("id").alias("a"), F.col("sig").alias("sa"), F.col("n").alias("na"))
    right = reps.select(F.col("id").alias("b"), F.col("sig").alias("sb"), F.col("n").alias("nb"))
    sized = f"least(na, nb) >= {threshold} * greatest(na, nb) - 1e-6"
    close = materialise(met.join(left, "a").join(right, "b").where(sized).where(f"{estimate('sa', 'sb')} >= {threshold - slack}D").select("a", "b"), "close")
    wanted = close.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = materialise(pages.join(wanted, "id", "left_semi").mapInArrow(_shingle_lists(size), "id long, s array<long>").dropDuplicates(["id"]), "shingles")
    discard(sketch)
    both = close.join(sets.select(F.col("id").alias("a"), F.col("s").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("s").alias("y")), "b")
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("k"), (F.size("x") + F.size("y")).alias("t"))
    links = both.select("a", "b", (F.col("k") / (F.col("t") - F.col("k"))).alias("jaccard")).where(f"jaccard >= {threshold}")
    return links, members


def components(links: DataFrame) -> DataFrame:
    """(node, root): each node of ``links(a, b)`` with the smallest node of its connected component.

    Stars are merged in turn: first every larger neighbour of a node is tied to the node's smallest one,
    then every smaller, which makes paths of any length one star in a logarithmic number of
    rounds.  A round is two aggregations by node that combine before they shuffle, and two joins whose
    hot side is split; its edges are a table in the shared folder."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    edges, seen = materialise(edges, "stars"), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
        made = materialise(small, "stars")
        now = tuple(made.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(edges)
        edges = made
        if now == seen or not now[0]:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicate_groups(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id, group) of every record that has a near-duplicate or an equal: records that links lead to from one
    another share a group, named by its smallest id.  Other records have no row."""
    roots = components(links).select(F.col("node").alias("rep"), "root")
    copies = members.groupBy("rep").agg(F.count("*").alias("n"))
    placed = copies.join(roots, "rep", "left").where("root is not null or n > 1").select("rep", F.coalesce("root", "rep").alias("group"))
    return members.join(placed, "rep").select("id", "group")
