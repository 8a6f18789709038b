"""Sliding-window admission of requests, in batch and in Structured Streaming.

A hit is admitted if fewer than ``limit`` admitted hits of its key lie less than
``window`` seconds before it; refused hits leave no trace, so no window count
over the raw hits can tell.  State is the key's last admitted times, at most
``limit`` of them, whatever the traffic.

Decisions of one key depend on each other, but not for ever.  Time is cut into
bins of one window.  If a bin and the one before it hold at most ``limit`` raw hits of a
key together, all hits of the bin are admitted whatever came earlier, and they alone are live
when the next bin begins: there the key's history is cut, the bin's
hits going along as known.  Only stretches of bins over the limit are walked in
order, so a key with a third of all hits is many tasks unless it is always refused.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType


def client_ip(forwarded: Column, remote: Column) -> Column:
    """The first forwarded address; without the header the peer's."""
    return F.when(forwarded.isNotNull(), F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))).otherwise(F.coalesce(remote, F.lit("0.0.0.0")))


def gated(hits: DataFrame, routes: list[str] | None = None) -> DataFrame:
    """Hits the limiter looks at: GET and POST on limited routes (all with a route by default)."""
    kept = hits.where(F.upper("method").isin("GET", "POST")).where("route is not null")
    return kept if routes is None else kept.where(F.col("route").isin(routes))


def admit(times: list[float], state: list[float], limit: int, window: float) -> tuple[list[bool], list[float]]:
    """Decisions for hits in order, and the new state."""
    live, out = deque(state), []
    for t in times:
        while live and live[0] <= t - window:
            live.popleft()
        out.append(len(live) < limit)
        if out[-1]:
            live.append(t)
    return out, list(live)


def stretches(hits: DataFrame, keys: list[str], at: str, limit: int, window_us: int) -> DataFrame:
    """``hits`` with ``__stretch`` and ``__known``: rows of one key and stretch are to be walked together,
    known ones (copies of the hits of the bin before a stretch) being admitted.  Keys meet by a hash: if two share one, their
    bins are counted together, which only makes cuts rarer."""
    own = hits.withColumn("__h", F.xxhash64(*keys)).withColumn("__bin", F.floor(F.col(at) / window_us).cast("long"))
    bins = own.groupBy("__h", "__bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("__h").orderBy("__bin")
    back = lambda k: F.sum("n").over(w.rangeBetween(-k, -1))
    # the bin before and the one before that, empty ones too
    cut = F.coalesce(back(2), F.lit(0)) <= limit
    marked = bins.select("__h", "__bin", cut.alias("cut")).withColumn("__stretch", F.max(F.when(F.col("cut"), F.col("__bin"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    follows = F.lead(F.when(F.col("cut"), F.col("__bin"))).over(w)
    marked = marked.select("__h", "__bin", "__stretch", F.when(follows == F.col("__bin") + 1, follows).alias("next"))
    placed = own.join(marked, ["__h", "__bin"])
    copies = F.when(F.col("next").isNull(), F.array(F.struct(F.col("__stretch").alias("s"), F.lit(False).alias("k")))).otherwise(F.array(F.struct(F.col("__stretch").alias("s"), F.lit(False).alias("k")), F.struct(F.col("next").alias("s"), F.lit(True).alias("k"))))
    return placed.withColumn("__x", F.explode(copies)).select(*hits.columns, "__h", F.col("__x.s").alias("__stretch"), F.col("__x.k").alias("__known"))


def admitted(hits: DataFrame, keys: list[str], order: list[str], limit: int, window_us: int) -> DataFrame:
    """``hits`` with ``admitted``.  ``order`` begins with the event's time in microseconds; the rest breaks ties.

    Rows are brought together by key and stretch (see :func:`stretches`) and sorted within their partition, and one pass
    keeps ``limit`` times of the current one; no stretch is ever held in memory.
    Rows with a null time are refused; null keys are keys; a limit below 1 refuses all."""
    names = hits.columns
    at = names.index(order[0])
    timed = stretches(hits.where(F.col(order[0]).isNotNull()), keys, order[0], max(limit, 0), window_us)
    sorted_ = timed.repartition("__h", "__stretch").sortWithinPartitions("__h", *keys, "__stretch", *order).drop("__h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, live = None, deque()
        for b in batches:
            key = zip(*[b.column(names.index(k)).to_pylist() for k in keys], b.column(len(names)).to_pylist())
            known = b.column(len(names) + 1).to_pylist()
            out = []
            for k, t, sure in zip(key, b.column(at).to_pylist(), known):
                if k != current:
                    current, live = k, deque()
                while live and live[0] <= t - window_us:
                    live.popleft()
                out.append(len(live) < limit)
                if out[-1]:
                    live.append(t)
            own = pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(out, pa.bool_())], [*names, "admitted"])
            yield own.filter(pa.array([not x for x in known], pa.bool_()))

    late = hits.where(F.col(order[0]).isNull()).withColumn("admitted", F.lit(False))
    schema = StructType([*hits.schema.fields, StructField("admitted", BooleanType())])
    return sorted_.mapInArrow(run, schema).unionByName(late)


def admitted_stream(hits: DataFrame, limit: int, window_s: float, late_s: float = 0) -> DataFrame:
    """Streaming form over ``hits(route, ip, ts)``: (route, ip, ts, admitted).  Within a batch hits are taken by time.

    State is kept by key and expires by event time: once the watermark, ``late_s`` behind the latest hit, is a window
    past a key's last admission, none of it can count any more.  A pause in the input expires nothing."""

    def step(key, parts, state):
        if state.hasTimedOut:
            state.remove()
            return
        live = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        times = [t.timestamp() for t in rows["ts"]]
        out, live = admit(times, live, limit, window_s)
        state.update((live,))
        if live:
            state.setTimeoutTimestamp(max(int((live[-1] + window_s) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"route": key[0], "ip": key[1], "ts": rows["ts"].to_numpy(), "admitted": out})

    dated = hits.withWatermark("ts", f"{late_s} seconds")
    return dated.groupBy("route", "ip").applyInPandasWithState(step, "route string, ip string, ts timestamp, admitted boolean", "live array<double>", "append", "EventTimeTimeout")
