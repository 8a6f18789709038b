"""The best targets of every source, scored exactly against blocks of targets.

A pair's relevance is a sum over shared terms, entities and tags in which no term can
be left out: BM25 parts are capped, cosine counts raw frequencies, and so
the frequent words alone decide between many targets.  Joining postings would thus make
a row of each shared term of nearly every pair.  Instead targets are dealt by a hash into
blocks of bounded size, and each block's index is written once into the folder that all executors share.
A task holds one block of sources, reads the indexes one after the other and keeps each source's best
``k`` targets so far; nothing but these leaves it, and no target is copied for a task in a shuffle.

Titles, entities, tags and languages bound what a pair can reach whatever its texts share.  A target
whose bound is below the source's ``k``-th best is passed over without a look at its text, which changes no
result.  For ``body_bm25`` the bound is the score itself in single precision.

Terms, entities, tags, urls and languages are compared by 64-bit hashes.  Document
frequencies and mean lengths are those of the whole corpus.  Blocks are even
whatever the data: no key of theirs can be hot.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkspark.functions import scores as S
from linkspark.functions import urls as U
from linkspark.operators.anchors import SHORT, named_phrases, target_phrases
from linkspark.workspace import shared_folder

#: What an entity is worth by its type.
ENTITY_WEIGHTS = {"product": 1.0, "brand": 0.8, "category": 0.6}
OTHER_ENTITY = 0.3
PAIRS = "src long, tgt long, title_bm25 double, body_bm25 double, cosine double, entity double, first_pos int, tag double, recall double, rank int"
SPANS = PAIRS + ", length int, hits array<struct<text:string,start:int,end:int,variant:string>>"
#: Rows of a block at most: what one task holds of each.
SOURCE_BLOCK, TARGET_BLOCK = 4096, {"recall": 32768, "title_bm25": 16384, "body_bm25": 32768}
#: Rows of the blocks that are scored together by recall: what is done once a source and block is done less often.
TOGETHER = 65_536
#: A body term in more than this share of a block's targets is multiplied as a dense row; sources multiplied at once.
DENSE, BATCH = 1 / 64, 256
#: Targets with like texts that are bounded together, and how many such chunks are scored first while a source has no best yet.
CHUNK, LIKELY = 128, 4
#: The body terms of a block, the most frequent ones, whose products bound a cosine before all terms are looked at.
OFTEN = 512
#: A title word, entity or tag in more than this share of a block's targets is held as a dense row.
LONG = 1 / 32
#: What bounds are widened by: far above the error of sums in double and in single precision.
SLACK, SINGLE = 1e-8, 1e-3


def entity_weight(kind: Column) -> Column:
    out = F.lit(OTHER_ENTITY)
    for k, w in ENTITY_WEIGHTS.items():
        out = F.when(kind == k, w).otherwise(out)
    return out


def coded(pages: DataFrame) -> DataFrame:
    """Prepared pages with what scoring reads: hashes of tokens (a title's apart from a body's), entities and tags,
    and the facts that gate a target on its own."""
    codes = lambda c, f: F.transform(c, lambda x: F.xxhash64(F.lit(f), x))
    known = lambda c: F.coalesce(F.xxhash64(F.when(F.col(c).isNotNull(), F.col(c))) * F.when(F.col(c).isNotNull(), 1), F.lit(0))
    title = F.lower("title")
    return pages.withColumns({
        "title_codes": codes("title_tokens", "title"), "body_codes": codes("body_tokens", "body"), "tag_codes": codes("tag_set", "tag"),
        "entity_codes": F.transform("entities", lambda e: F.xxhash64(F.lower(e["name"]))), "entity_weights": F.transform("entities", lambda e: entity_weight(e["type"])),
        "lang_code": known("lang"), "canonical_code": known("canonical"), "url_code": F.xxhash64("url"), "is_review": F.col("type") == "review", "is_product": F.col("type") == "product",
        "is_guide": F.col("type").isin("category", "review") & (title.contains("best") | title.contains("top") | title.contains("guide")),
        "open": ~F.col("noindex") & ~F.col("nofollow") & ~F.col("is_login") & ~F.col("is_cart") & (F.col("status_code") < 300) & ~U.tracking_only(F.col("url")),
    })


FACTS = "page_id title_codes body_codes tag_codes entity_codes entity_weights lang_code canonical_code url_code".split()


def field_alone(pages: DataFrame, field: str = "title") -> DataFrame:
    """:func:`coded` pages with nothing but titles or ``body`` texts to score."""
    other = {"title": "body", "body": "title"}[field]
    return pages.withColumns({c: F.array().cast("array<bigint>") for c in (f"{other}_codes", "tag_codes", "entity_codes")} | {"entity_weights": F.array().cast("array<double>")})


class _Lists:
    """An array column as flat values and offsets."""

    def __init__(self, column: pa.ChunkedArray) -> None:
        one = column.combine_chunks()
        one = one if isinstance(one, pa.Array) else pa.concat_arrays(one.chunks)
        self.offsets = one.offsets.to_numpy()
        self.values = one.values.to_numpy(zero_copy_only=False)

    def __getitem__(self, k: int) -> np.ndarray:
        return self.values[self.offsets[k] : self.offsets[k + 1]]

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Row and value of every element."""
        sizes = np.diff(self.offsets)
        return np.repeat(np.arange(len(sizes)), sizes), self.values[self.offsets[0] : self.offsets[-1]]


def _postings(lists: _Lists) -> dict[str, np.ndarray]:
    """Rows by code: each (code, row) once, with its count and its last place in the flat values."""
    rows, codes = lists.flat()
    order = np.argsort(codes, kind="stable")
    codes, rows = codes[order], rows[order]
    new = np.r_[True, (codes[1:] != codes[:-1]) | (rows[1:] != rows[:-1])] if len(codes) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(codes)])
    code, start = np.unique(codes[first], return_index=True)
    return {"code": code, "start": np.r_[start, len(first)].astype(np.int64), "row": rows[first].astype(np.int32), "count": count.astype(np.int32), "last": order[first + count - 1] if len(first) else first}


def _own(lists: _Lists, step: int = 1024) -> dict[str, np.ndarray]:
    """Codes, and by row the places of its distinct codes among them with their counts; made some rows at a time, since texts are long."""
    code = np.unique(lists.flat()[1])
    terms, counts, sizes = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for a in range(0, len(lists.offsets) - 1, step):
        ends = lists.offsets[a : a + step + 1]
        row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        key, count = np.unique(row * len(code) + np.searchsorted(code, lists.values[ends[0] : ends[-1]]), return_counts=True)
        terms.append((key % max(len(code), 1)).astype(np.int32))
        counts.append(count.astype(np.int32))
        sizes.append(np.bincount(key // max(len(code), 1), minlength=len(ends) - 1))
    return {"code": code, "own_term": np.concatenate(terms), "own_count": np.concatenate(counts), "own_start": np.cumsum(np.concatenate(sizes))}


def _alike(x: dict[str, np.ndarray], idf: np.ndarray, n: int, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """An order of ``n`` targets that brings like texts together (k-means by the most frequent terms), and where its chunks start.
    Results do not depend on it."""
    often = np.argsort(-np.bincount(x["own_term"], minlength=len(x["code"])), kind="stable")[:OFTEN]
    place = np.full(len(x["code"]), -1)
    place[often] = np.arange(len(often))
    hit = np.flatnonzero(place[x["own_term"]] >= 0)
    term = x["own_term"][hit]
    each = np.zeros((n, len(often)), np.float32)
    each[np.repeat(np.arange(n), np.diff(x["own_start"]))[hit], place[term]] = np.maximum(idf[term], 0.05)
    each /= np.maximum(np.linalg.norm(each, axis=1, keepdims=True), 1e-9)
    middles = max(1, n // CHUNK)
    middle = each[np.arange(middles) * n // middles]
    for _ in range(rounds):
        of = np.concatenate([(each[a : a + 2048] @ middle.T).argmax(axis=1) for a in range(0, n, 2048)])
        order = np.argsort(of, kind="stable")
        start = np.unique(of[order], return_index=True)[1]
        middle = np.add.reduceat(each[order], start, axis=0)
        middle /= np.maximum(np.linalg.norm(middle, axis=1, keepdims=True), 1e-9)
    place = np.arange(n) - np.repeat(start, np.diff(np.r_[start, n]))
    return order, np.flatnonzero(place % CHUNK == 0)


def _index(targets: pa.Table, words: pa.Table, facts: dict[str, Any]) -> dict[str, np.ndarray]:
    """What scoring reads of a block of targets; ``words`` has the corpus' document frequencies of the block's terms."""
    n = targets.num_rows
    column = lambda t, c: t.column(c).to_numpy()
    targets = targets.take(np.argsort(column(targets, "lang_code"), kind="stable"))  # each language is a stretch
    order = np.argsort(column(words, "code"))
    known, df = column(words, "code")[order], column(words, "df")[order]
    idf = np.log(1 + (facts["n"] - df + 0.5) / (df + 0.5))
    of = lambda codes: idf[np.searchsorted(known, codes)] if len(codes) else np.zeros(0)
    chunks = {}
    if facts["by"] == "body_bm25":
        x = _own(_Lists(targets.column("body_codes")))
        order, chunks["chunk"] = _alike(x, of(x["code"]), n)
        targets = targets.take(order)
    out = {c: column(targets, c) for c in ("page_id", "lang_code", "url_code", "canonical_code")} | {c: column(targets, c).astype(np.uint8) for c in ("is_guide", "is_product", "open")} | chunks
    k = lambda f, lists: S.K1 * (1 - S.B + S.B * np.diff(lists.offsets) / (facts[f] if facts[f] > 0 else 1.0))
    lists = _Lists(targets.column("title_codes"))
    x = _postings(lists)
    w = np.repeat(of(x["code"]), np.diff(x["start"])) * x["count"] * (S.K1 + 1) / (x["count"] + k("title", lists)[x["row"]])
    out |= {f"title_{c}": x[c] for c in ("code", "start", "row")} | {"title_w": w}
    lists = _Lists(targets.column("body_codes"))
    x = _own(lists)
    out |= {f"body_{c}": v for c, v in x.items()} | {"body_idf": of(x["code"]), "body_k": k("body", lists)}
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(x["own_start"]))
    out["body_norm"] = np.sqrt(np.bincount(row, weights=x["own_count"].astype(float) ** 2, minlength=n))
    if facts["by"] == "body_bm25":
        order = np.argsort(x["own_term"], kind="stable")
        out |= {"body_row": row[order], "body_count": x["own_count"][order], "body_start": np.searchsorted(x["own_term"][order], np.arange(len(x["code"]) + 1))}
    x = _postings(_Lists(targets.column("entity_codes")))
    x["w"] = _Lists(targets.column("entity_weights")).flat()[1][x["last"]]
    out |= {f"entity_{c}": x[c] for c in ("code", "start", "row", "w")}
    x = _postings(_Lists(targets.column("tag_codes")))
    return out | {f"tag_{c}": x[c] for c in ("code", "start", "row")} | {"n_tags": np.bincount(x["row"], weights=x["count"], minlength=n)}


def _write(index: dict[str, np.ndarray], path: str) -> None:
    index = {k: np.ascontiguousarray(v) for k, v in index.items()}
    head = json.dumps([(k, v.dtype.str, len(v)) for k, v in index.items()]).encode()
    where, at = fs.FileSystem.from_uri(path)
    where.create_dir(at.rsplit("/", 1)[0])
    with where.open_output_stream(at) as out:
        for x in (len(head).to_bytes(8, "little"), head, b" " * (-len(head) % 8), *(b for v in index.values() for b in (v.tobytes(), b" " * (-v.nbytes % 8)))):
            out.write(x)


def _read(path: str) -> dict[str, np.ndarray]:
    where, at = fs.FileSystem.from_uri(path)
    with where.open_input_file(at) as f:
        held = f.read_buffer()
    size = int.from_bytes(held[:8].to_pybytes(), "little")
    out, at = {}, 8 + size + -size % 8
    for k, kind, n in json.loads(held[8 : 8 + size].to_pybytes()):
        out[k] = np.frombuffer(held, np.dtype(kind), n, at)
        at += out[k].nbytes + -out[k].nbytes % 8
    return out


def _joined(parts: list[dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The indexes of some blocks as one, by the order of the blocks."""
    if len(parts) == 1:
        return parts[0]
    one = lambda c: np.concatenate([x[c] for x in parts])
    row = np.cumsum([0, *(len(x["page_id"]) for x in parts)])
    out = {c: one(c) for c in "page_id lang_code url_code canonical_code is_guide is_product open body_k body_norm n_tags body_own_count".split()}
    for f in ("title", "entity", "tag"):
        out[f"{f}_code"], of = np.unique(one(f"{f}_code"), return_inverse=True)
        key = np.repeat(of, np.concatenate([np.diff(x[f"{f}_start"]) for x in parts]))
        order = np.argsort(key, kind="stable")
        out[f"{f}_start"] = np.searchsorted(key[order], np.arange(len(out[f"{f}_code"]) + 1))
        out[f"{f}_row"] = np.concatenate([x[f"{f}_row"] + np.int32(r) for x, r in zip(parts, row)])[order]
        if f != "tag":
            out[f"{f}_w"] = one(f"{f}_w")[order]
    out["body_code"], of = np.unique(one("body_code"), return_inverse=True)
    out["body_idf"] = np.zeros(len(out["body_code"]))
    out["body_idf"][of] = one("body_idf")
    of = np.split(of.astype(np.int32), np.cumsum([len(x["body_code"]) for x in parts])[:-1])
    out["body_own_term"] = np.concatenate([c[x["body_own_term"]] for c, x in zip(of, parts)])
    held = np.cumsum([0, *(x["body_own_start"][-1] for x in parts)])
    return out | {"body_own_start": np.concatenate([[0], *(x["body_own_start"][1:] + h for x, h in zip(parts, held))])}


class _Sources:
    """A block of sources, and the best targets of each so far."""

    def __init__(self, rows: pa.Table, facts: dict[str, Any]) -> None:
        column = lambda c: rows.column(c).to_numpy()
        rows = rows.take(np.argsort(column("lang_code"), kind="stable"))  # sources of a batch have words in common
        self.n, self.facts = rows.num_rows, facts
        self.ids, self.lang, self.url, self.canonical, self.review = (column(c) for c in ("page_id", "lang_code", "url_code", "canonical_code", "is_review"))
        self.worth = _Lists(rows.column("entity_weights"))
        self.total = [self.worth[k].sum() for k in range(self.n)]
        # codes, counts and the start of each source; entities may repeat, each of them counts
        self.terms = {}
        for f in ("title", "body"):
            lists = _Lists(rows.column(f"{f}_codes"))
            each = [np.unique(lists[k], return_counts=True) for k in range(self.n)]
            self.terms[f] = (np.concatenate([x for x, _ in each]), np.concatenate([c for _, c in each]).astype(float), np.cumsum([0, *(len(x) for x, _ in each)]))
        _, q, at = self.terms["body"]
        self.norm = [float(np.sqrt((q[a:b] ** 2).sum())) for a, b in zip(at, at[1:])]
        for f in ("entity", "tag"):
            lists = _Lists(rows.column(f"{f}_codes"))
            self.terms[f] = (lists.flat()[1], None, lists.offsets - lists.offsets[0])
        self.best: list[tuple[np.ndarray, ...] | None] = [None] * self.n
        self.least = np.full(self.n, facts["floor"])
        self.slack = 10.0 ** -facts["digits"] + SLACK

    def meet(self, index: dict[str, np.ndarray]) -> None:
        """Score the targets of a block for each source."""
        block = _Block(index, self)
        for k in range(self.n):
            block.one(k)

    def keep(self, k: int, by: np.ndarray, rows: tuple[np.ndarray, ...]) -> None:
        """Merge scored targets (``by``: the rounded score, falling) with the best so far."""
        if self.best[k] is not None:
            old = self.best[k]
            by, rows = np.concatenate((old[0], by)), tuple(np.concatenate(x) for x in zip(old[1:], rows))
        order = np.lexsort((rows[0], by))[: self.facts["k"]]
        self.best[k] = (by[order], *(x[order] for x in rows))
        if len(order) == self.facts["k"]:
            self.least[k] = max(-self.best[k][0][-1], self.facts["floor"])

    def table(self) -> pa.Table:
        full = [(k, b[1:]) for k, b in enumerate(self.best) if b is not None]
        columns = [np.concatenate([np.full(len(b[0]), self.ids[k]) for k, b in full] or [np.zeros(0)])]
        columns += [np.concatenate([b[c] for _, b in full] or [np.zeros(0)]) for c in range(8)]
        columns.append(np.concatenate([np.arange(1, len(b[0]) + 1) for _, b in full] or [np.zeros(0)]))
        kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4, pa.int32(), pa.float64(), pa.float64(), pa.int32()]
        return pa.Table.from_arrays([pa.array(c, t, safe=False) for c, t in zip(columns, kinds)], [x.split()[0] for x in PAIRS.split(", ")])


def _hits(pairs: pa.Table, sources: pa.Table, folders: list[str]) -> pa.Table:
    """The pairs whose targets have a phrase in the source's text, with the first place of each phrase.

    Phrases are read a block of targets at a time; places count characters."""
    at = {p: k for k, p in enumerate(sources.column("page_id").to_pylist())}
    text, low = sources.column("text").to_pylist(), sources.column("low").to_pylist()
    codes, names, lengths, short, other = (sources.column(c).to_pylist() for c in ("entity_codes", "n_low", "n_len", "n_short", "n_other"))
    of = [at[p] for p in pairs.column("src").to_pylist()]
    tgt, first = pairs.column("tgt").to_numpy(), pairs.column("first_pos").to_pylist()
    found: dict[int, list[dict]] = {}
    for path in folders:
        where, there = fs.FileSystem.from_uri(path + ".phrases")
        with where.open_input_file(there) as f:
            block = pa.ipc.open_file(f).read_all()
        ids = block.column("page_id").to_numpy()
        order = np.argsort(ids)
        place = np.minimum(np.searchsorted(ids[order], tgt), len(ids) - 1)
        here = np.flatnonzero(ids[order][place] == tgt)
        phrases, sizes, variants, kinds, theirs = (block.column(c).to_pylist() for c in ("p_low", "p_len", "p_variant", "e_variant", "entity_codes"))
        for n, row in zip(here.tolist(), order[place[here]].tolist()):
            k = of[n]
            tried = set(zip(phrases[row], sizes[row], variants[row]))
            if first[n] >= 0:
                code = codes[k][first[n]]
                kind = kinds[row][len(theirs[row]) - 1 - theirs[row][::-1].index(code)]  # the last of its name counts
                if (short if kind in SHORT else other)[k][first[n]]:
                    tried.add((names[k][first[n]], lengths[k][first[n]], kind))
            for phrase, size, variant in tried:
                start = low[k].find(phrase)
                if start >= 0:
                    found.setdefault(n, []).append({"text": text[k][start : start + size], "start": start, "end": start + size, "variant": variant})
    kept = sorted(found)
    kind = pa.list_(pa.struct([("text", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("variant", pa.string())]))
    out = pairs.take(pa.array(kept, pa.int64()))
    return out.append_column("length", pa.array([len(text[of[n]]) for n in kept], pa.int32())).append_column("hits", pa.array([found[n] for n in kept], kind))


def _paired(pairs: pa.Table, sources: pa.Table, paths: list[str], kinds: dict[str, pa.DataType], rows_at_once: int = 10_000) -> Iterator[pa.RecordBatch]:
    """The pairs with both pages' attributes, a block of targets at a time: neither pages nor pairs are copied for a join."""
    sources = sources.combine_chunks()
    ids = sources.column("page_id").to_numpy()
    order = np.argsort(ids)
    of = order[np.searchsorted(ids[order], pairs.column("src").to_numpy())]
    tgt, first = pairs.column("tgt").to_numpy(), pairs.column("first_pos").to_numpy()
    struct = lambda rows, mark, at: pa.StructArray.from_arrays([rows.column(c).combine_chunks().take(at) for c in rows.column_names if c.startswith(mark)], [c[2:] for c in rows.column_names if c.startswith(mark)])
    names, codes = (sources.column(c).to_pylist() for c in ("e_name", "entity_codes")) if "first_entity" in kinds else ([], [])
    for path in paths:
        where, there = fs.FileSystem.from_uri(path + ".pages")
        with where.open_input_file(there) as f:
            block = pa.ipc.open_file(f).read_all().combine_chunks()
        ids = block.column("page_id").to_numpy()
        order = np.argsort(ids)
        place = order[np.minimum(np.searchsorted(ids[order], tgt), len(ids) - 1)]
        here = np.flatnonzero(ids[place] == tgt)
        types, theirs, known = (block.column("e_type").to_pylist(), block.column("entity_codes").to_pylist(), {}) if names else ([], [], {})
        for p in range(0, len(here), rows_at_once):
            now = here[p : p + rows_at_once]
            mine, its = pa.array(of[now]), pa.array(place[now])
            out = pairs.take(pa.array(now))
            for c, kind in kinds.items():
                if c == "first_entity":
                    found = []
                    for k, t, e in zip(of[now].tolist(), place[now].tolist(), first[now].tolist()):
                        if e >= 0 and t not in known:
                            known[t] = dict(zip(theirs[t], types[t]))  # the last of its name counts
                        found.append({"name": names[k][e], "type": known[t][codes[k][e]]} if e >= 0 else None)
                    out = out.append_column(c, pa.array(found, kind))
                else:
                    out = out.append_column(c, struct(sources, "s_", mine) if c == "s" else struct(block, "t_", its))
            yield from out.combine_chunks().to_batches()


class _Block:
    """The index of a block of targets, and where the terms of a block of sources are in it."""

    def __init__(self, index: dict[str, np.ndarray], sources: _Sources) -> None:
        self.x, self.s, self.n = index, sources, len(index["page_id"])
        self.at = {}
        for f in ("title", "body", "entity", "tag"):
            codes, known = sources.terms[f][0], index[f"{f}_code"]
            at = np.minimum(np.searchsorted(known, codes), max(len(known) - 1, 0))
            self.at[f] = np.where(known[at] == codes, at, -1) if len(known) else np.full(len(codes), -1)
        terms = len(index["body_code"])
        self.weight, self.count, self.asked = np.zeros(terms), np.zeros(terms), np.zeros(terms, bool)
        self.has_body = (index["body_norm"] > 0) * 1.0
        self.batch: tuple[int, np.ndarray, np.ndarray] | None = None
        if sources.facts["by"] == "title_bm25":
            # the most that a term adds, at the start of its postings
            self.title, self.title_most = np.zeros(self.n), np.zeros(len(index["title_w"]))
            if len(self.title_most):
                self.title_most[index["title_start"][:-1]] = np.maximum.reduceat(index["title_w"], index["title_start"][:-1])
        elif sources.facts["by"] == "body_bm25":
            self._dense()
            self.parts = (np.zeros(self.n), np.zeros(self.n), np.full(self.n, -1, np.int32), np.zeros(self.n))
        elif sources.facts["by"] == "recall":
            starts = np.flatnonzero(np.r_[True, np.diff(index["lang_code"]) != 0])
            self.stretches: dict[int, list[slice]] = {}
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), self.n]):
                self.stretches.setdefault(int(index["lang_code"][a]), []).append(slice(a, b))
            self._often()
            self._lists()

    def _often(self) -> None:
        """Counts of the most frequent terms by target, and what the others add to a target's norm at most."""
        x = self.x
        start = x["body_own_start"]
        steps = [(p, min(p + 4096, self.n)) for p in range(0, self.n, 4096)]
        sizes = sum(np.bincount(x["body_own_term"][start[p] : start[e]], minlength=len(x["body_code"])) for p, e in steps)
        often = np.argsort(-sizes, kind="stable")[:OFTEN]
        self.place = np.full(len(sizes), -1)
        self.place[often] = np.arange(len(often))
        self.counts = np.zeros((self.n, len(often)), np.uint8 if x["body_own_count"].max(initial=0) < 256 else np.float32)
        held = np.zeros(self.n)
        for p, e in steps:
            flat = slice(start[p], start[e])
            place = self.place[x["body_own_term"][flat]]
            hit = np.flatnonzero(place >= 0)
            row, count = np.repeat(np.arange(e - p), np.diff(start[p : e + 1]))[hit], x["body_own_count"][flat][hit]
            self.counts[p + row, place[hit]] = count
            held[p:e] = np.bincount(row, weights=count.astype(float) ** 2, minlength=e - p)
        norm = np.maximum(x["body_norm"], 1e-300)
        self.over = np.where(x["body_norm"] > 0, 1 / norm, 0.0)
        self.rest = np.sqrt(np.maximum(x["body_norm"] ** 2 - held, 0.0)) * self.over

    def _dense(self) -> None:
        x = self.x
        sizes = np.diff(x["body_start"])
        w = np.repeat(x["body_idf"], sizes) * x["body_count"] * (S.K1 + 1) / (x["body_count"] + x["body_k"][x["body_row"]])
        self.w = w.astype(np.float32)
        often = np.flatnonzero(sizes > self.n * DENSE)
        self.place = np.full(len(sizes), -1)
        self.place[often] = np.arange(len(often))
        own, start, tf = x["body_own_term"], x["body_own_start"], x["body_own_count"]
        row = np.repeat(np.arange(self.n), np.diff(start))
        w = (x["body_idf"][own] * tf * (S.K1 + 1) / (tf + x["body_k"][row])).astype(np.float32)
        ends = np.r_[x["chunk"][1:], self.n]
        self.chunks, self.chunk_most, at = [], np.zeros((len(often), len(ends)), np.float32), np.zeros(len(often), np.int64)
        for c, (a, b) in enumerate(zip(x["chunk"].tolist(), ends.tolist())):
            flat = slice(start[a], start[b])
            place = self.place[own[flat]]
            hit = np.flatnonzero(place >= 0)
            place, asked = place[hit], np.zeros(len(often), bool)
            asked[place] = True
            held = np.flatnonzero(asked)
            at[held] = np.arange(len(held))
            one = np.zeros((len(held), b - a), np.float32)
            one[at[place], row[flat][hit] - a] = w[flat][hit]
            self.chunk_most[held, c] = one.max(axis=1)
            self.chunks.append((a, b, held, one))

    def _bodies(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The targets that may be among a source's best by their texts, and their scores in single precision."""
        first = k - k % BATCH
        if self.batch is None or self.batch[0] != first:
            self.batch = (first, *self._several(first, min(first + BATCH, self.s.n)))
        top, reach = self.batch[1][k - first], self.batch[2][k - first]
        at = np.flatnonzero(top >= reach)
        top = top[at]
        if len(at) > self.s.facts["k"] + 1 and not self.s.facts["gated"]:
            near = top >= self._kth(top[None])[0]
            at, top = at[near], top[near]
        return at, top

    def _kth(self, scores: np.ndarray) -> np.ndarray:
        """What a score must reach, by row, that at most ``k`` others which count are above it for certain; the source itself does not count."""
        m = self.s.facts["k"] + self.s.facts["same"]
        if scores.shape[1] <= m:
            return np.zeros(len(scores))
        most = np.partition(scores, scores.shape[1] - m, axis=1)[:, scores.shape[1] - m].astype(float)
        return most - 2 * SINGLE * np.abs(most) - self.s.slack

    def _several(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """The body scores of some sources, and what each asks of a score.  A chunk of targets is passed over for a source if
        the most that each term has in it can't reach that; what it has there is less than the score then, and doesn't reach it either."""
        x, at, (_, q, start) = self.x, self.at["body"], self.s.terms["body"]
        a, b = start[first], start[last]
        source = np.repeat(np.arange(last - first), np.diff(start[first : last + 1]))
        at, q = at[a:b], q[a:b].astype(np.float32)
        place = np.where(at >= 0, self.place[at], -1) if len(self.place) else np.full(b - a, -1)
        asked = np.zeros((last - first, len(self.chunk_most)), np.float32)
        asked[source[place >= 0], place[place >= 0]] = q[place >= 0]
        out = np.zeros((last - first, self.n), np.float32)
        rare = np.flatnonzero((at >= 0) & (place < 0))
        begin = x["body_start"][at[rare]]
        sizes = x["body_start"][at[rare] + 1] - begin
        flat = np.repeat(begin - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        np.add.at(out.reshape(-1), np.repeat(source[rare] * self.n, sizes) + x["body_row"][flat], np.repeat(q[rare], sizes) * self.w[flat])
        bound = asked @ self.chunk_most + np.maximum.reduceat(out, x["chunk"], axis=1)
        reach = np.maximum([self._reach(k) for k in range(first, last)], 1e-30)
        new = np.array([(best := self.s.best[k]) is None or len(best[0]) < self.s.facts["k"] for k in range(first, last)])
        if len(self.chunks) > LIKELY and new.any() and not self.s.facts["gated"]:
            likely = (bound >= np.partition(bound, -LIKELY, axis=1)[:, [-LIKELY]]) & new[:, None]
            self._fill(out, asked, likely)
            reach[new] = np.maximum(reach[new], self._kth(out[new]))
            self._fill(out, asked, (bound >= reach[:, None]) & ~likely)
        else:
            self._fill(out, asked, bound >= reach[:, None])
        return out, reach

    def _fill(self, out: np.ndarray, asked: np.ndarray, wanted: np.ndarray) -> None:
        """Add what the dense terms of the chunks that are ``wanted`` (by source) give."""
        for c in np.flatnonzero(wanted.any(axis=0)):
            a, b, held, w = self.chunks[c]
            who = np.flatnonzero(wanted[:, c])
            mine = asked[who]
            some = np.flatnonzero(mine.any(axis=0)[held])
            out[who, a:b] += mine.take(held[some], axis=1) @ w[some]

    def _found(self, f: str, k: int) -> list[tuple[int, int, int, int]]:
        """Of each term of a source that the block has: its place in the source, in all sources, and its postings."""
        a, b = self.s.terms[f][2][k : k + 2]
        at, start = self.at[f][a:b], self.x[f"{f}_start"]
        p = np.flatnonzero(at >= 0)
        at = at[p]
        return list(zip(p.tolist(), (p + a).tolist(), start[at].tolist(), start[at + 1].tolist()))

    def _factor(self, k: int, of: slice | np.ndarray, common: np.ndarray) -> np.ndarray:
        """The language and review factors of some targets."""
        x, own = self.x, self.s.lang[k]
        theirs = x["lang_code"][of]
        if own == 0 or len(theirs) and isinstance(of, slice) and theirs[0] == theirs[-1] and theirs[0] in (0, own):
            out = np.full(len(theirs), 0.7 if own == 0 or theirs[0] == 0 else 1.0)
        else:
            out = np.where((theirs == 0) | (own == 0), 0.7, np.where(theirs == own, 1.0, np.where(common[of] > 0, 0.6, 0.1)))
        return out * np.where(x["is_guide"][of] > 0, 1.2, np.where(x["is_product"][of] > 0, 1.1, 1.0)) if self.s.review[k] else out

    def one(self, k: int) -> None:
        """Score the targets for one source, those first that cannot be passed over."""
        x, s, facts, n = self.x, self.s, self.s.facts, self.n
        if facts["by"] == "title_bm25" and facts["alone"]:
            return self._titles(k)
        if facts["by"] == "recall":
            return self._recall(k)
        if facts["alone"]:
            return self._texts(k)
        title, entity, common, first, total = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -1, np.int32), s.total[k]
        for _, p, a, b in self._found("title", k):
            title[x["title_row"][a:b]] += s.terms["title"][1][p] * x["title_w"][a:b]
        for p, _, a, b in reversed(self._found("entity", k)):  # the smallest place is written last
            rows = x["entity_row"][a:b]
            first[rows] = p
            entity[rows] += np.maximum(s.worth[k][p], x["entity_w"][a:b])
        for _, _, a, b in self._found("tag", k):
            common[x["tag_row"][a:b]] += 1
        a, b = s.terms["body"][2][k : k + 2]
        found, q = self.at["body"][a:b], s.terms["body"][1][a:b]
        found, q = found[found >= 0], q[found >= 0]
        self.weight[found], self.count[found], self.asked[found] = q * x["body_idf"][found], q, True
        parts = (title, entity, first, common)
        if facts["by"] == "title_bm25":
            self._exact(k, self._first_titles(k, np.flatnonzero((title > facts["floor"]) & (title >= s.least[k] - s.slack)), title)[0], parts)
        else:
            self._best_first(k, *self._bodies(k), parts)
        self.weight[found] = self.count[found] = 0.0
        self.asked[found] = False

    def _first_titles(self, k: int, at: np.ndarray, title: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` best of ``at`` by their titles, ties by page_id, and their rounded scores, falling from below."""
        facts, at = self.s.facts, self._allowed(k, at)
        by = -np.round(title[at], facts["digits"])
        if len(at) > facts["k"]:
            near = by <= np.partition(by, facts["k"] - 1)[facts["k"] - 1]
            at, by = at[near], by[near]
            order = np.lexsort((self.x["page_id"][at], by))[: facts["k"]]
            at, by = at[order], by[order]
        return at, by

    def _titles(self, k: int) -> None:
        """Title scores alone.  A target that has only terms which together can't reach the source's ``k``-th best is
        passed over: those terms are looked up for the targets of the others."""
        x, s, n = self.x, self.s, self.n
        found = [(s.terms["title"][1][p], a, b) for _, p, a, b in self._found("title", k)]
        found = sorted(((q * self.title_most[a], q, a, b) for q, a, b in found), reverse=True)
        left, reach, cut = 0.0, self._reach(k), len(found)
        while cut and left + found[cut - 1][0] < reach:
            cut -= 1
            left += found[cut][0]
        title = self.title
        for _, q, a, b in found[:cut]:
            title[x["title_row"][a:b]] += q * x["title_w"][a:b]
        if sum(b - a for *_, a, b in found[:cut]) * 8 > n:
            some = np.flatnonzero(title)
        else:
            some = np.unique(np.concatenate([np.zeros(0, np.int32), *[x["title_row"][a:b] for *_, a, b in found[:cut]]]))
        for most, q, a, b in found[cut:]:
            some, gone = (some[near := title[some] + left >= reach], some[~near])
            title[gone] = 0.0
            rows = x["title_row"][a:b]
            place = np.minimum(np.searchsorted(rows, some), len(rows) - 1)
            title[some] += np.where(rows[place] == some, q * x["title_w"][a:b][place], 0.0)
            left -= most
        at, by = self._first_titles(k, some[(title[some] > s.facts["floor"]) & (title[some] >= s.least[k] - s.slack)], title)
        if len(at):
            none = np.zeros(len(at))
            s.keep(k, by, (x["page_id"][at], title[at], none, none, none, np.full(len(at), -1, np.int32), none, none))
        title[some] = 0.0

    def _texts(self, k: int) -> None:
        """Text scores alone."""
        x, s = self.x, self.s
        at, top = self._bodies(k)
        if not len(at):
            return
        a, b = s.terms["body"][2][k : k + 2]
        found, q = self.at["body"][a:b], s.terms["body"][1][a:b]
        found, q = found[found >= 0], q[found >= 0]
        self.weight[found], self.count[found], self.asked[found] = q * x["body_idf"][found], q, True
        self._best_first(k, at, top, self.parts)
        self.weight[found] = self.count[found] = 0.0
        self.asked[found] = False

    def _reach(self, k: int) -> float:
        """What a bound must reach that the target isn't passed over."""
        least = self.s.least[k] - self.s.slack
        return least - SINGLE * abs(least) if self.s.facts["by"] == "body_bm25" else least

    def _lists(self) -> None:
        """Titles, entities and tags as one set of lists: the most that each adds to a score, its rows, and a dense row where it is long."""
        x, fields = self.x, ("title", "entity", "tag")
        held = [len(x[f"{f}_row"]) for f in fields]
        self.base = dict(zip(fields, np.cumsum([0, *held])))
        self.first_list = dict(zip(fields, np.cumsum([0, *(len(x[f"{f}_code"]) for f in fields)])))
        self.row = np.concatenate([x[f"{f}_row"] for f in fields])
        self.value = np.concatenate((x["title_w"], x["entity_w"], np.ones(held[2])))
        self.start = np.concatenate([*(x[f"{f}_start"][:-1] + self.base[f] for f in fields), [len(self.row)]])
        self.most = np.maximum.reduceat(self.value, self.start[:-1]) if len(self.row) else np.zeros(0)
        long = np.flatnonzero(np.diff(self.start) > max(self.n * LONG, 1))
        self.long = np.full(len(self.start) - 1, -1)
        self.long[long] = np.arange(len(long))
        self.wide = np.zeros((len(long), self.n))
        for p, t in enumerate(long):
            a, b = self.start[t : t + 2]
            self.wide[p, self.row[a:b]] = self.value[a:b]
        self.marked, self.where = np.zeros(self.n, bool), np.full(self.n, -1)
        self.parts = (np.zeros(self.n), np.zeros(self.n), np.full(self.n, -1, np.int32), np.zeros(self.n))

    def _rows(self, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of some lists' rows, and of each the list's place among them."""
        start = self.start[lists]
        sizes = self.start[lists + 1] - start
        ends = np.cumsum(sizes)
        of = np.repeat(np.arange(len(lists)), sizes)
        return (start - (ends - sizes))[of] + np.arange(len(of)), of

    def _recall(self, k: int) -> None:
        """A target that has only lists which together can't reach the source's ``k``-th best is passed over unseen."""
        x, s, most, each, kinds, lists, factor_of = self.x, self.s, 0.0, [], [], [], []
        own, per, own_tags = int(s.lang[k]), 0.25 / s.total[k] if s.total[k] > 0 else 0.0, s.terms["tag"][2][k + 1] - s.terms["tag"][2][k]
        for kind, f in enumerate(("title", "entity", "tag")):
            a, b = s.terms[f][2][k : k + 2]
            at = self.at[f][a:b]
            p = np.flatnonzero(at >= 0)
            at = at[p] + self.first_list[f]
            lists.append(at)
            kinds.append(np.full(len(at), kind))
            each.append(p)
            factor_of.append(s.terms["title"][1][a:b][p] if kind == 0 else s.worth[k][p] if kind == 1 else np.ones(len(at)))
        adds = np.concatenate((np.minimum(factor_of[0] * self.most[lists[0]] * (0.35 / 8), 0.35), np.minimum(np.maximum(factor_of[1], self.most[lists[1]]) * per, 0.25), np.full(len(lists[2]), 0.15 / max(own_tags, 1))))
        held, kinds, each, weights = np.concatenate(lists), np.concatenate(kinds), np.concatenate(each), np.concatenate(factor_of)
        sizes = self.start[held + 1] - self.start[held]
        a, b = s.terms["body"][2][k : k + 2]
        found, q = self.at["body"][a:b], s.terms["body"][1][a:b]
        found, q = found[found >= 0], q[found >= 0]
        body = 0.35 * min(float((q * x["body_idf"][found]).sum()) * (S.K1 + 1) / 12, 1.0)
        most = body + 0.2 if len(q) else 0.0
        self.weight[found], self.count[found], self.asked[found] = q * x["body_idf"][found], q, True
        asked = (body, most, per, own_tags, found, q, held, kinds, each, weights)
        seen = np.zeros(0, np.int64)
        if len(held) and (s.best[k] is None or len(s.best[k][0]) < s.facts["k"]):
            # nothing is asked of a target yet: the likeliest of the short lists are scored first
            at, top = self._bounds(k, self._union(held[self.long[held] < 0]), *asked, first_look=True)
            some = s.facts["k"] + 40
            seen = at[np.argpartition(-top, some)[:some]] if len(at) > some else at
            self._exact(k, seen, self.parts)
        reach = self._reach(k)
        order = np.argsort(adds / np.maximum(sizes, 1), kind="stable")
        some = self._likely(own, 1.2 if s.review[k] else 1.0, reach - SLACK, held[order], np.cumsum(adds[order]), most, lists[2])
        if len(seen):
            self.marked[seen] = True
            some = some[~self.marked[some]]
            self.marked[seen] = False
        at, top = self._bounds(k, some, *asked)
        self._best_first(k, at, top, self.parts)
        self.weight[found] = self.count[found] = 0.0
        self.asked[found] = False

    def _likely(self, own: int, review: float, reach: float, lists: np.ndarray, sums: np.ndarray, most: float, tags: np.ndarray) -> np.ndarray:
        """Targets that may reach what a source asks by their language and their lists.  ``sums``: what the first of ``lists`` add together."""
        total = most + (sums[-1] if len(sums) else 0.0)
        if 0.1 * review * total >= reach and own != 0:
            return np.arange(self.n)
        near = lambda f: self._union(lists[most + sums >= reach / (f * review)])
        out = []
        for c, f in ((0, 0.7), (own, 1.0)) if own != 0 else ((None, 0.7),):
            of = self.stretches.get(c, []) if c is not None else [slice(0, self.n)]
            if not of or f * review * total < reach:
                continue
            if f * review * most >= reach:
                out += [np.arange(x.start, x.stop) for x in of]
            else:
                rows = near(f)
                out += [rows[np.searchsorted(rows, x.start) : np.searchsorted(rows, x.stop)] for x in of]
        if own != 0 and 0.6 * review * total >= reach:  # other languages need a common tag
            rows = self._union(tags) if 0.6 * review * most >= reach else near(0.6)
            theirs = self.x["lang_code"][rows]
            out.append(rows[(theirs != 0) & (theirs != own)])
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def _union(self, lists: np.ndarray) -> np.ndarray:
        """The targets that have any of some lists."""
        if not len(lists):
            return np.zeros(0, np.int64)
        for t in lists[self.long[lists] >= 0]:
            self.marked[self.row[self.start[t] : self.start[t + 1]]] = True
        short = lists[self.long[lists] < 0]
        if len(short):
            self.marked[self.row[self._rows(short)[0]]] = True
        out = np.flatnonzero(self.marked)
        self.marked[out] = False
        return out

    def _bounds(self, k: int, some: np.ndarray, body: float, most: float, per: float, own_tags: int, found: np.ndarray, q: np.ndarray, held: np.ndarray, kinds: np.ndarray, each: np.ndarray, weights: np.ndarray, first_look: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``some`` that may reach what the source asks, and the most that each can have; writes their ``parts``."""
        x, s, n, reach = self.x, self.s, len(some), self._reach(k)
        if not n:
            return some, np.zeros(0)
        title, entity, common, first = np.zeros(n), np.zeros(n), np.zeros(n), np.full(n, -1, np.int32)
        short = np.flatnonzero(self.long[held] < 0)
        if len(short):
            self.where[some] = np.arange(n)
            flat, of = self._rows(held[short])
            place = self.where[self.row[flat]]
            self.where[some] = -1
            hit = np.flatnonzero(place >= 0)
            place, of, value = place[hit], short[of[hit]], self.value[flat[hit]]
            kind = kinds[of]
            t, e, g = (np.flatnonzero(kind == c) for c in range(3))
            title += np.bincount(place[t], weights=weights[of[t]] * value[t], minlength=n)
            entity += np.bincount(place[e], weights=np.maximum(weights[of[e]], value[e]), minlength=n)
            first[place[e][::-1]] = each[of[e]][::-1]  # the smallest place is written last
            common += np.bincount(place[g], minlength=n)
        for p in np.flatnonzero(self.long[held] >= 0):
            value = self.wide[self.long[held[p]]][some]
            if kinds[p] == 0:
                title += weights[p] * value
            elif kinds[p] == 2:
                common += value
            else:
                hit = np.flatnonzero(value)
                entity[hit] += np.maximum(weights[p], value[hit])
                first[hit] = np.where(first[hit] < 0, each[p], np.minimum(first[hit], each[p]))
        self.parts[3][some] = common
        factor = self._factor(k, some, self.parts[3])
        rest = np.minimum(title * (0.35 / 8), 0.35) + np.minimum(entity * per, 0.25) + 0.15 * common / np.maximum(own_tags + x["n_tags"][some] - common, 1)
        near = np.flatnonzero((rest + most * self.has_body[some]) * factor >= reach)
        at, rest, factor = some[near], rest[near], factor[near]
        for whole, part in zip(self.parts, (title, entity, first)):
            whole[at] = part[near]
        if first_look or not len(at) or not len(q):
            return at, (rest + most * self.has_body[at]) * factor
        place = self.place[found]
        asked = np.zeros(self.counts.shape[1], np.float32)
        asked[place[place >= 0]] = q[place >= 0]
        left = np.sqrt(max(s.norm[k] ** 2 - float((asked.astype(float) ** 2).sum()), 0.0)) / s.norm[k]
        cosine = np.empty(len(at))
        for p in range(0, len(at), 1024):
            cosine[p : p + 1024] = self.counts[at[p : p + 1024]].astype(np.float32) @ asked
        cosine *= self.over[at] * (1 + SINGLE) / s.norm[k]
        cosine += left * self.rest[at] + SLACK
        top = (rest + body * self.has_body[at] + 0.2 * np.minimum(cosine, 1.0)) * factor
        near = np.flatnonzero(top >= reach)
        return at[near], top[near]

    def _best_first(self, k: int, at: np.ndarray, top: np.ndarray, parts: tuple[np.ndarray, ...]) -> None:
        """Exact scores of ``at``, the likeliest first: they raise what the others must reach.  ``top`` belongs to ``at`` or to all."""
        top = top[at] if len(top) != len(at) else top
        some = self.s.facts["k"] + 40
        while len(at):
            if len(at) > 2 * some:
                cut = np.argpartition(-top, some)
                now, at, top = at[cut[:some]], at[cut[some:]], top[cut[some:]]
            else:
                now, at, top = at, at[:0], top[:0]
            self._exact(k, now, parts)
            left = top >= self._reach(k)
            at, top, some = at[left], top[left], 2 * some

    def _allowed(self, k: int, at: np.ndarray) -> np.ndarray:
        x, s = self.x, self.s
        if s.facts["same"]:
            at = at[x["page_id"][at] != s.ids[k]]
        if s.facts["gated"]:
            at = at[(x["open"][at] > 0) & (x["url_code"][at] != s.url[k]) & ~((x["canonical_code"][at] == s.canonical[k]) & (s.canonical[k] != 0))]
        return at

    def _exact(self, k: int, at: np.ndarray, parts: tuple[np.ndarray, ...]) -> None:
        x, s, facts = self.x, self.s, self.s.facts
        at = self._allowed(k, at)
        if not len(at):
            return
        title, entity, first, common = (p[at] for p in parts)
        entity = np.minimum(entity / s.total[k], 1.0) if s.total[k] > 0 else np.zeros(len(at))
        tag = common / np.maximum(s.terms["tag"][2][k + 1] - s.terms["tag"][2][k] + x["n_tags"][at] - common, 1)
        factor = self._factor(k, at, parts[3])
        start = x["body_own_start"][at]
        sizes = x["body_own_start"][at + 1] - start
        ends = np.cumsum(sizes)
        flat = np.repeat(start - (ends - sizes), sizes)
        flat += np.arange(len(flat))
        hit = np.flatnonzero(self.asked.take(x["body_own_term"].take(flat)))
        row = np.repeat(np.arange(len(at)), np.diff(np.searchsorted(hit, ends), prepend=0))
        flat = flat[hit]
        term, tf = x["body_own_term"][flat], x["body_own_count"][flat]
        body = np.bincount(row, weights=self.weight[term] * (tf * (S.K1 + 1) / (tf + x["body_k"][at][row])), minlength=len(at))
        dot = np.bincount(row, weights=self.count[term] * tf, minlength=len(at))
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where(dot > 0, dot / (s.norm[k] * x["body_norm"][at]), 0.0)
        recall = (0.35 * np.minimum(title / 8, 1) + 0.35 * np.minimum(body / 12, 1) + 0.2 * cosine + 0.25 * entity + 0.15 * tag) * factor
        rank = {"recall": recall, "title_bm25": title, "body_bm25": body}[facts["by"]]
        kept = np.flatnonzero((rank > facts["floor"]) & (rank >= s.least[k] - s.slack))
        if len(kept):
            s.keep(k, -np.round(rank[kept], facts["digits"]), tuple(c[kept] for c in (x["page_id"][at], title, body, cosine, entity, first, tag, recall)))


def best_pairs(sources: DataFrame, corpus: DataFrame, k: int, by: str = "recall", floor: float = 0.05, digits: int = 9, gated: bool = True, source_block: int = SOURCE_BLOCK, target_block: int | None = None, spans: bool = False, alone: bool = False, own: Sequence[str] = (), theirs: Sequence[str] = (), entity: bool = False) -> DataFrame:
    """(src, tgt, title_bm25, body_bm25, cosine, entity, first_pos, tag, recall, rank) of the ``k`` best targets of each source of
    :func:`coded` pages by ``by`` (``recall``, ``title_bm25`` or ``body_bm25``) above ``floor``, ties to ``digits`` places by page_id.

    A source's repeated terms count each time; ``first_pos`` is the place of the first of its entities that the target has, or -1.
    ``gated`` leaves out targets that may not be linked at all, equal urls and equal canonicals.  If ``sources`` is
    ``corpus`` itself a page is no target of its own; pages of two tables are told apart by their urls alone.
    ``spans`` keeps the pairs alone whose source text holds a phrase of the target, with ``hits`` (text, start, end, variant) and the text's ``length``.
    ``alone`` reads nothing but titles, by titles, or texts, by texts: the scores of others are 0 and ``first_pos`` -1.
    ``own`` and ``theirs`` are columns that come along in structs ``s`` of the source and ``t`` of the target; ``entity`` adds ``first_entity``: the first
    of the source's entities that the target has, with the target's type.
    Ids are unique in each table; a page without shared terms, entities and tags has no row; either table may be empty."""
    if alone:
        if by == "recall" or spans:
            raise ValueError("alone is for titles or texts")
        corpus, sources = (one := field_alone(corpus, by.split("_")[0])), one if sources is corpus else field_alone(sources, by.split("_")[0])
    target_block = target_block or TARGET_BLOCK[by]
    together = max(1, TOGETHER // target_block) if by == "recall" else 1
    same = sources is corpus
    spark = corpus.sparkSession
    stats = corpus.agg(F.count("*").alias("n"), F.avg(F.size("title_codes")).alias("title"), F.avg(F.size("body_codes")).alias("body")).first()
    n_sources = stats["n"] if same else sources.count()
    targets = max(1, -(-stats["n"] // target_block))
    cores = spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n_sources // source_block), min(4 * cores, -(-n_sources // 64)))
    facts = {"n": stats["n"], "title": stats["title"] or 1.0, "body": stats["body"] or 1.0, "by": by, "floor": floor, "digits": digits, "gated": gated, "same": same, "k": int(k), "alone": alone}

    deal = lambda rows: F.pmod(F.xxhash64("page_id"), F.lit(rows)).cast("int")
    held = target_phrases() if spans else {}
    carried = {f"t_{c}": F.col(c) for c in theirs} | ({"e_type": F.transform("entities", lambda e: e["type"])} if entity else {})
    schema = T.StructType([*T.StructType.fromDDL(SPANS if spans else PAIRS).fields, *[T.StructField(n, T.StructType([f.schema[c] for c in columns])) for n, f, columns in (("s", sources, own), ("t", corpus, theirs)) if columns]])
    schema = schema.add("first_entity", T.StructType().add("name", "string").add("type", "string")) if entity else schema
    with_pages = bool(own or theirs or entity)
    kinds = {"s": pa.null(), "t": pa.null(), "first_entity": pa.struct([("name", pa.string()), ("type", pa.string())])}
    kinds = {c: kinds[c] for c in schema.names if c in kinds}
    words = corpus.select(deal(targets).alias("w_part"), F.explode(F.array_union("title_codes", "body_codes")).alias("code")).groupBy("w_part", "code").agg(F.count("*").alias("n"))
    words = words.withColumn("df", F.sum("n").over(Window.partitionBy("code"))).select("w_part", "code", "df").repartition(targets, "w_part")
    right = (corpus.where("open") if gated else corpus).select(*FACTS, "is_guide", "is_product", "open", *[c.alias(n) for n, c in (held | carried).items()]).withColumn("part", deal(targets)).repartition(targets, "part")
    folder = shared_folder(spark, "index")
    phrases, with_them = list(held), ["page_id", "entity_codes", *carried]

    def written(rows: pa.Table, found: pa.Table) -> pa.Table:
        path = f"{folder}/{uuid.uuid4().hex}"
        if rows.num_rows:
            _write(_index(rows, found, facts), path)
            if spans:
                where, there = fs.FileSystem.from_uri(path + ".phrases")
                with where.open_output_stream(there) as f, pa.ipc.new_file(f, (some := rows.select(["page_id", "entity_codes", *phrases])).schema) as out:
                    out.write_table(some)
            if with_pages:
                where, there = fs.FileSystem.from_uri(path + ".pages")
                with where.open_output_stream(there) as f, pa.ipc.new_file(f, (some := rows.select(with_them)).schema) as out:
                    out.write_table(some)
        return pa.table({"path": [path] * (rows.num_rows > 0)}, schema=pa.schema([("path", pa.string())]))

    paths = sorted(r["path"] for r in right.groupBy("part").cogroup(words.groupBy("w_part")).applyInArrow(written, "path string").collect())

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            block = _Sources(rows, facts)
            for p in range(0, len(paths), together):
                block.meet(_joined([_read(path) for path in paths[p : p + together]]))
            made = block.table()
            del block
            if with_pages:
                yield from _paired(made, rows, paths, kinds)
            else:
                yield from (_hits(made, rows, paths) if spans else made).to_batches(max_chunksize=50_000)

    brought = [*[F.col(c).alias(f"s_{c}") for c in own], *([F.transform("entities", lambda e: e["name"]).alias("e_name")] if entity else [])]
    more = ["text", F.lower("text").alias("low"), *[c.alias(n) for n, c in named_phrases(F.col("entities")).items()]] if spans else []
    left = sources.select(*FACTS, "is_review", *more, *brought, deal(blocks).alias("block")).repartitionById(blocks, "block").drop("block")
    return left.mapInArrow(scored, schema)
