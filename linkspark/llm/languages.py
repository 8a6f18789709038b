"""Languages of documents and of their mixed-language stretches.

A multinomial naive Bayes model over hashed character n-grams (orders 1 to 4
within words; characters of scripts without spaces count as words).  The model
is one matrix of log probabilities, 2^17 buckets by languages, some 7 MB whatever the
corpus, and travels to the tasks as a broadcast variable.  Batches are scored
sparsely: a word's score vector is the sum of its buckets' rows and is kept, a
segment's is the sum over its words.  Segments (sentences, headings, items,
menu entries) of a page are then labelled together by the best path under a
switching cost, so that short ones follow their neighbours.

Fitting: labelled samples first; then, from at most ``fit_pages`` pages (taken in
the order of a hash of their id), lines of pages whose stated language agrees with
the first model's are added, which brings in menus and notices.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.samples import bounded_sample

BUCKETS = 1 << 17
#: Codes and English names of the languages.
NAMES = {
    "en": "eng english", "fr": "fra fre french", "de": "deu ger german", "es": "spa spanish", "pt": "por portuguese", "it": "ita italian", "nl": "nld dut dutch",
    "ru": "rus russian", "ja": "jpn japanese", "zh": "zho chi chinese", "ar": "ara arabic", "hi": "hin hindi", "th": "tha thai",
}
SOLO = "぀-ヿ㐀-鿿฀-๿"
TOKEN = re.compile(rf"[{SOLO}]|[^\W\d_{SOLO}][^\s\d!-&(-/:-@\[-`{{-~…。！？、，：「」『』（）“”„«»·›|؟،।{SOLO}]*")
#: Ends of sentences and separators of menu entries.
CUT = re.compile(r"[.!?…؟।][\"”“»’)\]]*\s+|[。！？][”’」』）]*\s*|\s[|·>›/•»—–]\s+|[|·›•\t]\s*")
#: A run of another script inside a text without spaces, long enough to be a sentence.
FOREIGN = re.compile(rf"(?<=[{SOLO}])\s+(?=(?:[^\W\d_{SOLO}]+[\s,'’0-9-]+){{4}})|(?<=[^\W\d_{SOLO}])\s+(?=[{SOLO}]{{6}})")
SWITCH_IN, SWITCH_OUT, SCALE = 20.0, 14.0, 0.5


def stated_language(lang: Column) -> Column:
    """The two-letter code a label states by ISO 639-1 or 639-2 code, with or without
    region or script and in any case, or by English name; null if it states none."""
    clean = F.lower(F.regexp_replace(lang, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    head = F.regexp_extract(clean, r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    out = F.lit(None).cast("string")
    for code, names in NAMES.items():
        out = F.when(head.isin(code, *names.split()), code).otherwise(out)
    return out


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the words, by order and character (0 where an n-gram would
    leave its word, which the mask tells), and where each word starts."""
    padded = [f"\u0002{w.lower()}\u0003" for w in words]
    starts = np.r_[0, np.cumsum([len(w) for w in padded])]
    codes = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(n)
    out, inside = np.zeros((4, n), np.int64), np.zeros((4, n), bool)
    h = np.zeros(n, np.uint64)
    for k in range(4):
        h = h * np.uint64(0x9E3779B97F4A7C15) + np.r_[codes[k:], np.zeros(k, np.uint64)] + np.uint64(k + 1)
        mixed = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out[k] = (mixed >> np.uint64(64 - 17)).astype(np.int64)
        inside[k] = left > k
    inside[0] &= codes > 3
    out[~inside] = 0
    return out, inside, starts[:-1]


def segments(line: str) -> list[str]:
    pieces = CUT.split(line)
    if line and max(line) >= "\u0e00":
        pieces = [part for piece in pieces for part in FOREIGN.split(piece)]
    return pieces


class Model:
    """Log probabilities, centred over the languages, and the scoring of texts."""

    def __init__(self, langs: list[str], logp: np.ndarray) -> None:
        self.langs, self.logp = langs, logp
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1 << 12, len(langs)), np.float32)
        self.letters = np.zeros((1 << 12, 2), np.int32)

    def __getstate__(self):
        return {"langs": self.langs, "logp": self.logp}

    def __setstate__(self, state) -> None:
        self.__init__(state["langs"], state["logp"])

    @classmethod
    def fit(cls, counts: dict[str, np.ndarray], smooth: float = 0.02) -> Model:
        """``counts`` has each language's n-grams by bucket; all get the same total."""
        langs = sorted(counts)
        table = np.zeros((BUCKETS, len(langs)))
        for k, lang in enumerate(langs):
            table[:, k] = counts[lang]
        table *= 50_000 / np.maximum(table.sum(axis=0), 1)
        logp = np.log(table + smooth) - np.log(50_000 + smooth * BUCKETS)
        return cls(langs, (logp - logp.mean(axis=1, keepdims=True)).astype(np.float32))

    def index(self, words: set[str]) -> None:
        known = self.known
        if len(known) > 300_000:
            known.clear()
        new = [w for w in words if w not in known]
        if not new:
            return
        need = len(known) + len(new)
        if need > len(self.rows):
            size = max(need, 2 * len(self.rows))
            self.rows = np.vstack([self.rows, np.zeros((size - len(self.rows), self.rows.shape[1]), np.float32)])
            self.letters = np.vstack([self.letters, np.zeros((size - len(self.letters), 2), np.int32)])
        at = len(known)
        for k, w in enumerate(new):
            known[w] = at + k
            n = sum(map(str.isalpha, w))
            self.letters[at + k] = (n, n if len(w) == 1 and "฀" <= w <= "鿿" else 0)
        for lo in range(0, len(new), 20_000):
            found, inside, starts = grams(new[lo : lo + 20_000])
            total = sum(self.logp[found[k]] * inside[k][:, None] for k in range(4))
            self.rows[at + lo : at + lo + len(starts)] = np.add.reduceat(total, starts, axis=0)

    def label(self, pages: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each segment: page index, line number, language index, confidence, (letters, solo letters)."""
        page, line, first, words = [], [], [], []
        for p, text in enumerate(pages):
            for k, row in enumerate(text.split("\n"), 1):
                for s in segments(row):
                    found = TOKEN.findall(s)
                    if found:
                        page.append(p)
                        line.append(k)
                        first.append(len(words))
                        words += found
        n = len(page)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z, np.zeros(0), np.zeros((0, 2), np.int64)
        self.index(set(words))
        ids = np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))
        score = np.add.reduceat(self.rows[ids], first, axis=0) * SCALE
        letters = np.add.reduceat(self.letters[ids], first, axis=0)
        page, line = np.array(page), np.array(line)
        return page, line, self._path(page, line, score), self._sure(score), letters

    @staticmethod
    def _sure(score: np.ndarray) -> np.ndarray:
        e = np.exp(score - score.max(axis=1, keepdims=True))
        return e.max(axis=1) / e.sum(axis=1)

    @staticmethod
    def _path(page: np.ndarray, line: np.ndarray, score: np.ndarray) -> np.ndarray:
        """Best labels of each page's segments; pages advance together, one segment a step."""
        n, k = score.shape
        start = np.flatnonzero(np.r_[True, page[1:] != page[:-1]])
        size = np.diff(np.r_[start, n])
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        back = np.zeros((n, k), np.int8)
        best = score[start].astype(np.float64)
        for t in range(1, int(size[0]) if len(size) else 0):
            live = int(np.searchsorted(-size, -t, side="left"))
            at = start[:live] + t
            cost = np.where(line[at] == line[at - 1], SWITCH_IN, SWITCH_OUT)
            top = best[:live].argmax(axis=1)
            stay = best[:live]
            move = stay[np.arange(live), top] - cost
            back[at] = np.where(stay >= move[:, None], np.arange(k, dtype=np.int8)[None, :], top[:, None].astype(np.int8))
            best[:live] = np.maximum(stay, move[:, None]) + score[at]
        out = np.zeros(n, np.int64)
        state = best.argmax(axis=1)
        for t in range(int(size[0]) - 1 if len(size) else -1, -1, -1):
            live = int(np.searchsorted(-size, -t, side="left"))
            at = start[:live] + t
            out[at] = state[:live]
            state[:live] = back[at, state[:live]]
        return out


def _gram_counts(words: Counter) -> np.ndarray:
    out, every = np.zeros(BUCKETS), list(words)
    for lo in range(0, len(every), 20_000):
        part = every[lo : lo + 20_000]
        found, inside, starts = grams(part)
        weight = np.repeat(np.array([words[w] for w in part], float), np.diff(np.r_[starts, found.shape[1]]))
        for k in range(4):
            out += np.bincount(found[k][inside[k]], weight[inside[k]], BUCKETS)
    return out


def fit_model(samples: DataFrame, pages: DataFrame | None = None, fit_pages: int = 2000) -> Model:
    """Fit on ``samples(lang, text)`` and, if given, up to ``fit_pages`` rows of
    ``pages(page_id, lang, text)``; at most ``fit_pages`` sample rows for each of the 13 languages count.
    Rows without text or stated language are left out."""
    words: dict[str, Counter] = defaultdict(Counter)
    known = samples.select(stated_language(F.col("lang")).alias("lang"), "text").where("lang is not null and text is not null")
    for lang, text in bounded_sample(known, "text", fit_pages * len(NAMES)):
        words[lang].update(TOKEN.findall(text))
    counts = {lang: _gram_counts(c) for lang, c in words.items()}
    if not counts:
        raise ValueError("no labelled sample")
    model = Model.fit(counts)
    if pages is None:
        return model
    own = pages.select("page_id", stated_language(F.col("lang")).alias("lang"), "text").where("lang is not null and length(text) > 0")
    rows = bounded_sample(own, "page_id", fit_pages)
    more: dict[str, Counter] = defaultdict(Counter)
    for at in range(0, len(rows), 256):
        part = rows[at : at + 256]
        page, line, lang, _, letters = model.label([r["text"] for r in part])
        for p, r in enumerate(part):
            mine = page == p
            total = Counter()
            for k, n in zip(lang[mine], letters[mine, 0]):
                total[model.langs[k]] += int(n)
            if r["lang"] not in total or total[r["lang"]] < 0.8 * sum(total.values()):
                continue
            other = set(line[mine][lang[mine] != model.langs.index(r["lang"])].tolist())
            for k, row in enumerate(r["text"].split("\n"), 1):
                if k not in other:
                    more[r["lang"]].update(TOKEN.findall(row))
    for lang, seen in more.items():
        c = _gram_counts(seen)
        counts[lang] = counts[lang] + c * (counts[lang].sum() / max(1.0, c.sum()))
    return Model.fit(counts)


#: Least letters of a language in a line; for scripts without spaces, of its own characters.
LEAST, LEAST_SOLO, SOLO_LANGS = 40, 12, ("ja", "zh", "th")


def _labeller(shared, chunk: int = 512):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        solo = np.array([x in SOLO_LANGS for x in model.langs])
        names = np.array(model.langs)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out: list[tuple] = []
            at = 0
            while at < len(ids):
                end, size = at, 0
                while end < len(ids) and end - at < chunk and size < 4_000_000:
                    size += len(texts[end])
                    end += 1
                page, line, lang, sure, letters = model.label(texts[at:end])
                if len(page):
                    key = (page * (1 << 32) + line) * 16 + lang
                    kinds, back = np.unique(key, return_inverse=True)
                    total = np.zeros((len(kinds), 2), np.int64)
                    np.add.at(total, back, letters)
                    weight = np.zeros(len(kinds))
                    np.add.at(weight, back, sure * letters[:, 0])
                    k = kinds % 16
                    p, n = (kinds // 16) >> 32, (kinds // 16) & 0xFFFFFFFF
                    out.append((np.array(ids, object)[at:end][p], n, names[k], weight / np.maximum(total[:, 0], 1), total[:, 0], total[:, 1], np.where(solo[k], total[:, 1] >= LEAST_SOLO, total[:, 0] >= LEAST)))
                at = end
            cols = [np.concatenate([o[i] for o in out]) if out else np.zeros(0) for i in range(7)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(cols[0]), pa.int64()), pa.array(cols[1].astype(np.int64)), pa.array(list(cols[2]), pa.string()), pa.array(cols[3].astype(np.float64)),
                 pa.array(cols[4].astype(np.int64)), pa.array(cols[5].astype(np.int64)), pa.array(cols[6].astype(bool))],
                ["id", "line_no", "lang_code", "confidence", "letters", "solo_letters", "counts"])

    return run


def line_languages(pages: DataFrame, id_col: str, text_col: str, model: Model) -> DataFrame:
    """(id, line_no, lang_code, confidence, letters, solo_letters, counts): one row for
    each line and each language found in it; ``counts`` says whether it holds letters
    enough.  Lines count from 1.  Null ids and null texts are left out, lines without
    letters have no row, repeated rows give repeated rows; other columns are ignored."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    texts = pages.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    return texts.mapInArrow(_labeller(shared), "id long, line_no long, lang_code string, confidence double, letters long, solo_letters long, counts boolean")


def page_languages(lines: DataFrame) -> DataFrame:
    """(id, lang_code, confidence, share): each document's main language by letters."""
    per = lines.groupBy("id", "lang_code").agg(F.sum("letters").alias("n"), F.sum(F.col("confidence") * F.col("letters")).alias("w"))
    top = per.groupBy("id").agg(F.max(F.struct("n", "lang_code", "w")).alias("m"), F.sum("n").alias("all"))
    return top.select("id", F.col("m.lang_code").alias("lang_code"), (F.col("m.w") / F.greatest(F.col("m.n"), F.lit(1))).alias("confidence"), (F.col("m.n") / F.greatest(F.col("all"), F.lit(1))).alias("share"))
