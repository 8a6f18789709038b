"""Mixing sources to target weights by iterative proportional fitting.

Every document's tokens are counted by a public tokenizer; the token table is
then summed into cells of source, language and topic.  Raking looks for uses

    use(s, l, t) = min(cap, tokens * a(s) * b(l) * c(t)),   cap = tokens * max_repeats(s)

whose sums meet the target tokens of every source and the wanted shares of the
languages and topics.  The factor of a source is solved exactly (its breakpoints
are where cells reach their caps); those of languages and topics, some twenty
numbers, are scaled in turn until nothing moves.  A source that stays below its
target with all its cells at their caps is short.

A cell's fitted use is the expected number of copies of its documents; each
document gets the whole part and, by a hash of its id, one more with the
probability of the fraction.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.llm.languages import stated_language
from linkspark.workspace import materialise

#: Fixed value: the pre-tokenisation pattern that belongs to the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Topics by extension of the first file of a change.
TOPICS = {
    "code": "py js ts go c h cc cpp rs java rb sh kt scala", "web": "css html htm scss vue svg", "data": "sql yml yaml json toml csv xml ini lock", "docs": "md rst txt adoc",
}


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, shared.value.splitlines()) if a}
        coder = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            counts = [len(coder.encode_ordinary(t.as_py())) if t.is_valid else 0 for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.int64())], [*batch.schema.names[:-1], "tokens"])

    return run


def topic_of(text: Column) -> Column:
    ext = F.lower(F.regexp_extract(text, r"(?m)^diff --git \S+ \S*\.(\w+)\s*$", 1))
    out = F.when(ext == "", "none").otherwise("other")
    for topic, exts in TOPICS.items():
        out = F.when(ext.isin(*exts.split()), topic).otherwise(out)
    return F.coalesce(out, F.lit("none"))


def token_counts(docs: DataFrame, id_col: str, text_col: str, source_col: str, lang_col: str, vocabulary: str) -> DataFrame:
    """(id, source, lang, topic, tokens) of every row.  Null texts count 0 tokens; a null
    source stays null; a label that states no language becomes ``und``.  ``vocabulary`` is the path of a
    tiktoken rank file of a byte-level tokenizer; it is read on the
    driver and sent to the tasks as bytes, about 1 MB whatever the corpus."""
    if not os.path.isfile(vocabulary):
        raise FileNotFoundError(f"no tokenizer vocabulary at {vocabulary}: name a rank file by the setting spark.linkspark.vocabulary or the argument")
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    source = F.nullif(F.lower(F.trim(F.col(source_col))), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), source.alias("source"), F.coalesce(stated_language(F.col(lang_col)), F.lit("und")).alias("lang"), topic_of(F.col(text_col)).alias("topic"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_counter(shared), "id long, source string, lang string, topic string, tokens long")


class Marginals:
    """Wanted shares of languages and topics and the factors that lead to them."""

    def __init__(self, langs: list[str], topics: list[str], lang_share: np.ndarray, topic_share: np.ndarray) -> None:
        self.langs, self.topics, self.lang_share, self.topic_share = langs, topics, lang_share, topic_share
        self.b, self.c = np.ones(len(langs)), np.ones(len(topics))

    def weights(self) -> np.ndarray:
        """The factor of each (language, topic), flat."""
        return np.outer(self.b, self.c).ravel()

    def scale(self, by_lang: np.ndarray, by_topic: np.ndarray) -> float:
        """New factors from the tokens reached; returns the largest miss of a reachable share."""
        total, miss = max(by_lang.sum(), 1e-300), 0.0
        for have, share, factor in ((by_lang, self.lang_share, self.b), (by_topic, self.topic_share, self.c)):
            want = share * total
            open_ = (have > 0) & (want > 0)
            miss = max(miss, float(np.abs(have - want)[open_].sum() / total))
            # the square root damps the two scalings, which are made from the same sums
            factor[open_] = np.clip(factor[open_] * np.sqrt(want[open_] / have[open_]), 1e-6, 1e6)
            factor[want <= 0] = 0
        return miss


def fit_sources(tokens: np.ndarray, repeats: np.ndarray, goal: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Uses of the cells of some sources (a row each): ``min(cap, tokens * weight * a)`` with the
    factor ``a`` that meets the row's goal, or all cells at their caps where these hold no more."""
    caps = tokens * repeats[:, None]
    base = tokens * weights[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = np.where(base > 0, repeats[:, None] / np.maximum(weights[None, :], 1e-300), np.inf)  # where a cell reaches its cap
    order = np.argsort(turn, axis=1, kind="stable")
    sorted_turn, sorted_base, sorted_caps = (np.take_along_axis(x, order, 1) for x in (turn, base, np.where(base > 0, caps, 0.0)))
    full = np.cumsum(sorted_caps, axis=1) - sorted_caps  # tokens of the cells that are at their caps before the k-th is
    slope = np.cumsum(sorted_base[:, ::-1], axis=1)[:, ::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(slope > 0, (goal[:, None] - full) / slope, np.inf)
    right = a <= sorted_turn
    k = np.argmax(right, axis=1)
    rows = np.arange(len(tokens))
    factor = np.maximum(a[rows, k], 0.0)
    met = right.any(axis=1) & np.isfinite(factor)
    use = np.minimum(caps, base * np.where(met, factor, 0.0)[:, None])
    return np.where((caps.sum(axis=1) <= goal)[:, None], caps, np.where(met[:, None], use, np.where(base > 0, caps, 0.0)))


def _by(use: np.ndarray, langs: int, topics: int) -> tuple[np.ndarray, np.ndarray]:
    cube = use.reshape(-1, langs, topics).sum(axis=0)
    return cube.sum(axis=1), cube.sum(axis=0)


def rake(tokens: np.ndarray, repeats: np.ndarray, goal: np.ndarray, wanted: Marginals, rounds: int = 200, precision: float = 1e-6) -> tuple[np.ndarray, int, bool]:
    """(uses, rounds, converged) of ``tokens`` (sources by languages x topics, flat)."""
    use = np.zeros_like(tokens)
    for n in range(1, rounds + 1):
        use = fit_sources(tokens, repeats, goal, wanted.weights())
        if wanted.scale(*_by(use, len(wanted.langs), len(wanted.topics))) < precision:
            return use, n, True
    return use, rounds, False


def _rows_in_tasks(wanted: Marginals):
    """The fit of each source row where it lies: (source, use)."""
    weights = wanted.weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                tokens = np.array(b.column(1).to_pylist(), float)
                use = fit_sources(tokens, np.array(b.column(2).to_pylist(), float), np.array(b.column(3).to_pylist(), float), weights)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(use), pa.list_(pa.float64()))], ["source", "use"])

    return run


def rake_table(rows: DataFrame, wanted: Marginals, rounds: int = 200, precision: float = 1e-6, local_rows: int = 20_000) -> tuple[DataFrame, int, bool]:
    """``(source, use)`` of ``rows(source, tokens, repeats, goal)``, rounds and whether it converged.

    At most ``local_rows`` sources are fitted on the driver; more stay where they are, and
    each round sends some twenty factors out and as many sums back.  Both ways run
    the same kernel."""
    spark, shape = rows.sparkSession, (len(wanted.langs), len(wanted.topics))
    n = rows.limit(local_rows + 1).count()
    if n <= local_rows:
        got = rows.select("source", "tokens", "repeats", "goal").collect()
        tokens = np.array([r["tokens"] for r in got], float).reshape(len(got), -1)
        use, k, done = rake(tokens, np.array([r["repeats"] for r in got], float), np.array([r["goal"] for r in got], float), wanted, rounds, precision)
        return spark.createDataFrame([(r["source"], [float(x) for x in u]) for r, u in zip(got, use)], "source string, use array<double>"), k, done
    rows = rows.select("source", "tokens", "repeats", "goal")
    for k in range(1, rounds + 1):
        fitted = rows.mapInArrow(_rows_in_tasks(wanted), "source string, use array<double>")
        sums = fitted.select(F.posexplode("use").alias("at", "u")).groupBy("at").agg(F.sum("u").alias("u")).collect()  # languages x topics rows
        cube = np.zeros((1, shape[0] * shape[1]))
        for r in sums:
            cube[0, r["at"]] = r["u"]
        if wanted.scale(*_by(cube, *shape)) < precision:
            return fitted, k, True
    return fitted, rounds, False


def _shares(table: DataFrame | None, names: list[str], own: np.ndarray) -> np.ndarray:
    """Wanted shares of ``names`` by ``table(name, share)``, else the corpus' own; they sum to 1."""
    if table is None:
        share = own
    else:
        stated = {r[0]: float(r[1] or 0) for r in table.where(F.lower(F.trim(table.columns[0])).isin(names)).select(F.lower(F.trim(table.columns[0])), table.columns[1]).collect()} if names else {}
        share = np.array([max(stated.get(x, 0.0), 0.0) for x in names])
    return share / share.sum() if share.sum() > 0 else share


class Mix:
    """``report(source, target_share, max_repeats, tokens, target_tokens, fitted_tokens, short, mix_tokens, mix_share)``,
    ``shares(kind, name, wanted, fitted)`` of languages and topics, ``sample(id, source, copies)``,
    and ``rounds`` and ``converged`` of the raking."""

    def __init__(self, report: DataFrame, shares: DataFrame, sample: DataFrame, rounds: int, converged: bool) -> None:
        self.report, self.shares, self.sample, self.rounds, self.converged = report, shares, sample, rounds, converged


def mix_sources(counts: DataFrame, targets: DataFrame, size: float | None = None, seed: int = 1, languages: DataFrame | None = None, topics: DataFrame | None = None, local_rows: int = 20_000) -> Mix:
    """The mix of ``counts``, a result of :func:`token_counts`, by ``targets(source, target_share, max_repeats)``.

    Sources are compared lower-cased and trimmed; of repeated targets the smallest row
    counts.  ``size`` defaults to half the tokens of all documents, those of other or
    no source included.  ``languages(name, share)`` and ``topics(name, share)`` state wanted
    shares of the mix (those not named get none); by default the listed sources' own are kept.  A source is ``short``
    if its fitted tokens stay below its target, which raking allows only with each of its documents
    used ``max_repeats`` times.  A shortfall of the languages or topics against caps shows in ``shares`` and ``converged``.
    Null shares count 0, null or negative repeats 0; without documents all is 0."""
    spark = counts.sparkSession
    wanted = targets.select(F.lower(F.trim("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("share"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(0)), F.lit(0)).alias("repeats"))
    wanted = wanted.where("source <> ''").groupBy("source").agg(F.min(F.struct("share", "repeats")).alias("t")).select("source", "t.share", "t.repeats")
    cells = counts.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    listed = materialise(cells.join(wanted, "source", "left").select("source", "lang", "topic", "tokens", F.col("share").isNotNull().alias("listed")), "cells")
    if size is None:
        size = float(listed.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]) / 2
    own = [tuple(r) for r in listed.where("listed").groupBy("lang", "topic").agg(F.sum("tokens").alias("n")).collect()]  # at most 14 languages x 6 topics
    langs, kinds = sorted({r[0] for r in own}), sorted({r[1] for r in own})
    cube = np.zeros((len(langs), len(kinds)))
    for a, t, n in own:
        cube[langs.index(a), kinds.index(t)] += n
    marginals = Marginals(langs, kinds, _shares(languages, langs, cube.sum(axis=1)), _shares(topics, kinds, cube.sum(axis=0)))
    places = spark.createDataFrame([(a, t, i * len(kinds) + j) for i, a in enumerate(langs) for j, t in enumerate(kinds)], "lang string, topic string, at int")
    width = len(langs) * len(kinds)
    held = listed.where("listed").join(F.broadcast(places), ["lang", "topic"]).groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("at", "tokens"))).alias("m"))
    filled = F.transform(F.sequence(F.lit(0), F.lit(max(width - 1, 0))), lambda k: F.coalesce(F.element_at("m", k), F.lit(0)).cast("double"))
    rows = wanted.join(held, "source", "left").select("source", "share", "repeats", F.when(F.col("m").isNull(), F.array_repeat(F.lit(0.0), max(width, 1))).otherwise(filled).alias("tokens"), (F.col("share") * float(size)).alias("goal"))
    if width:
        fitted, rounds, done = rake_table(rows, marginals, local_rows=local_rows)
    else:
        fitted, rounds, done = rows.select("source", F.array(F.lit(0.0)).alias("use")), 0, True
    fitted = materialise(rows.join(fitted, "source").select("source", "share", "repeats", "tokens", "goal", "use"), "fitted")

    total = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, x: acc + x)
    flat = fitted.select("source", F.posexplode(F.arrays_zip("tokens", "use")).alias("at", "z")).where("z.tokens > 0").join(F.broadcast(places), "at").select("source", "lang", "topic", F.col("z.use").alias("use"), (F.col("z.use") / F.col("z.tokens")).alias("weight"))
    unit = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    used = counts.join(flat, ["source", "lang", "topic"]).withColumn("copies", (F.floor("weight") + F.when(unit < F.col("weight") - F.floor("weight"), 1).otherwise(0)).cast("int"))
    reached = used.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mix_tokens"))
    report = fitted.select("source", F.col("share").alias("target_share"), F.col("repeats").cast("int").alias("max_repeats"), total("tokens").cast("long").alias("tokens"), F.col("goal").alias("target_tokens"), total("use").alias("fitted_tokens"))
    report = report.withColumn("short", F.col("fitted_tokens") < F.col("target_tokens") * (1 - 1e-9)).join(reached, "source", "left").withColumn("mix_tokens", F.coalesce("mix_tokens", F.lit(0)))
    every = reached.agg(F.coalesce(F.sum("mix_tokens"), F.lit(0)).alias("all"))  # one row
    report = report.crossJoin(every).withColumn("mix_share", F.when(F.col("all") > 0, F.col("mix_tokens") / F.col("all")).otherwise(0.0)).drop("all")
    goals = [("language", x, float(s)) for x, s in zip(langs, marginals.lang_share)] + [("topic", x, float(s)) for x, s in zip(kinds, marginals.topic_share)]
    fit = flat.select(F.explode(F.array(F.struct(F.lit("language").alias("kind"), F.col("lang").alias("name"), "use"), F.struct(F.lit("topic").alias("kind"), F.col("topic").alias("name"), "use"))).alias("x")).groupBy("x.kind", "x.name").agg(F.sum("x.use").alias("use"))
    all_use = fitted.agg(F.coalesce(F.sum(total("use")), F.lit(0.0)).alias("all"))  # one row
    shares = spark.createDataFrame(goals, "kind string, name string, wanted double").join(fit, ["kind", "name"], "left").crossJoin(all_use)
    shares = shares.select("kind", "name", "wanted", F.when(F.col("all") > 0, F.coalesce("use", F.lit(0.0)) / F.col("all")).otherwise(0.0).alias("fitted"))
    return Mix(report, shares, used.where("copies > 0").select("id", "source", "copies"), rounds, done)


def counted(docs: DataFrame, vocabulary: str) -> DataFrame:
    """The token table of a commit corpus, written once to the shared folder."""
    return materialise(token_counts(docs, "doc_id", "text", "source", "lang", vocabulary), "tokens")
