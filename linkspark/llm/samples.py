"""Bounded samples of labelled rows for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def bounded_sample(rows: DataFrame, id_col: str, most: int) -> list[Row]:
    """At most ``most`` rows in the order of a hash of their id, the same on every run.

    A count first bounds the hash, so that about twice ``most`` rows leave the tasks
    whatever the number of rows and partitions."""
    n = rows.count()
    if n > 4 * most:
        rows = rows.where(F.pmod(F.xxhash64(id_col), F.lit(1 << 30)) < int(2 * most / n * (1 << 30)))
    return rows.orderBy(F.xxhash64(id_col), id_col).limit(most).collect()
