"""Timestamps and hierarchies against brute force and on edge cases."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from linkspark.operators.hierarchy import closure, descendant_counts, parent_edges, resolve_hierarchy
from linkspark.operators.timestamps import normalise_timestamps, page_timestamps
from linkspark.queries.general import QUERIES

PAGE = "page_id long, domain_id long, published_at string"
CLOCK = "domain_id long, tz_name string, date_order string"


def micros(y, mo, d, h=0, mi=0, s=0, us=0):
    return int(datetime(y, mo, d, h, mi, s, tzinfo=timezone.utc).timestamp()) * 1_000_000 + us


CASES = [
    (1, "2024-11-03 01:30:00 EST", micros(2024, 11, 3, 6, 30)), (1, "2024-11-03 01:30:00 EDT", micros(2024, 11, 3, 5, 30)), (1, "2024-11-03T01:30:00", micros(2024, 11, 3, 5, 30)),
    (1, "2024-03-10 02:30:00", micros(2024, 3, 10, 7, 30)), (1, "03/04/2024 5:06 PM", micros(2024, 3, 4, 22, 6)), (2, "03/04/2024 17:06", micros(2024, 4, 3, 16, 6)), (1, "03.04.2024 12:00:00", micros(2024, 4, 3, 16)),
    (2, "2024-10-27 01:30:00 GMT", micros(2024, 10, 27, 1, 30)), (2, "2024-10-27 01:30:00 BST", micros(2024, 10, 27, 0, 30)), (2, "2024-W01-1", micros(2024, 1, 1)), (2, "2024-366", micros(2024, 12, 31)),
    (2, "2023-366", None), (2, "2024-W53-1", None), (2, "2020-W53-5", micros(2021, 1, 1)), (2, "1700000000", micros(2023, 11, 14, 22, 13, 20)), (2, "1700000000123", micros(2023, 11, 14, 22, 13, 20, 123000)),
    (2, "1700000000123456", micros(2023, 11, 14, 22, 13, 20, 123456)), (2, "99", None), (2, "20240229", micros(2024, 2, 29)), (2, "20230229", None), (2, "20240101120000", micros(2024, 1, 1, 12)),
    (2, "2021-07-31T17:43:52.278123999Z", micros(2021, 7, 31, 17, 43, 52, 278123)), (2, "Tue, 01 Feb 2022 19:45:24 +0100", micros(2022, 2, 1, 18, 45, 24)), (1, "2024-01-01T00:00:00[Asia/Tokyo]", micros(2023, 12, 31, 15)),
    (2, "11. Oktober 2023, 01:01 Uhr", micros(2023, 10, 11, 0, 1)), (2, "10 de marzo de 2025, 16:21", micros(2025, 3, 10, 16, 21)), (2, "2020年3月11日 18時19分", micros(2020, 3, 11, 18, 19)), (2, "10 août 2019 à 02:45", micros(2019, 8, 10, 1, 45)),
    (2, "May 3, 2020 12:05 AM", micros(2020, 5, 2, 23, 5)), (2, "2024-01-01 10:00:00 UTC-03:00", micros(2024, 1, 1, 13)), (2, "2022-04-11T25:61:00", None), (2, "draft", None), (2, "", None), (2, None, None), (3, "2024-01-01", None), (2, " 2024-01-01T00:00:00z\n", micros(2024, 1, 1)), (2, "x" * 100_000, None),
]


def test_timestamp_cases(spark):
    pages = spark.createDataFrame([(k, d, v) for k, (d, v, _) in enumerate(CASES)], PAGE)
    clock = spark.createDataFrame([(1, "America/New_York", "mdy"), (2, "Europe/London", "dmy"), (2, "Europe/London", "dmy"), (4, "No/Where", None)], CLOCK)
    got = {r["page_id"]: r["utc_micros"] for r in page_timestamps(pages, clock).collect()}
    assert {k: got[k] for k in got} == {k: w for k, (_, _, w) in enumerate(CASES)}


def test_local_times_follow_zone_rules(spark):
    zoneinfo = pytest.importorskip("zoneinfo")
    rng, rows = random.Random(5), []
    zones = ["America/New_York", "Europe/Paris", "Australia/Sydney", "Asia/Kolkata", "Europe/Moscow"]
    for k in range(400):
        month, day = rng.choice([(3, 10), (3, 31), (10, 27), (11, 3), (4, 7), (10, 6), rng.choice([(1, 5), (7, 9)])])
        rows.append((k, datetime(2024, month, day, rng.randrange(5), rng.randrange(60), rng.randrange(60)), rng.choice(zones)))
    df = spark.createDataFrame([(k, t.isoformat(), z) for k, t, z in rows], "id long, v string, z string")
    got = {r["id"]: r["at"] for r in normalise_timestamps(df, "v", "z", out="at").collect()}
    for k, t, z in rows:
        want = t.replace(tzinfo=zoneinfo.ZoneInfo(z), fold=0)
        assert got[k] == round(want.timestamp()) * 1_000_000, (t, z)


def test_long_timestamps(spark):
    blank = " " * 200_000
    values = [blank + "2024-01-01T00:00:00Z" + blank, "2021-07-31T17:43:52.278123" + "9" * 5_000 + "Z", "\u3000" * 300 + "2024-01-01", "2024-01-01" + blank + "12:00:00Z", "x" + blank + "y", "2024-01-01" + blank + "x", "2024-01-01T00:00:00." + "1" * 5_000 + "x"]
    df = spark.createDataFrame([(k, v, "UTC") for k, v in enumerate(values)], "id int, v string, z string")
    got = {r["id"]: r["at"] for r in normalise_timestamps(df, "v", "z", out="at").collect()}
    assert [got[k] for k in range(len(values))] == [micros(2024, 1, 1), micros(2021, 7, 31, 17, 43, 52, 278123), micros(2024, 1, 1), micros(2024, 1, 1, 12), None, None, None]


def test_timestamps_keep_columns_and_rows(spark):
    df = spark.createDataFrame([(1, "2024-01-01", "a"), (1, "2024-01-01", "a")], "__at int, v string, utc_micros string")
    out = normalise_timestamps(df, "v", out="us")
    assert out.columns == ["__at", "v", "utc_micros", "us", "us_form"] and out.count() == 2
    assert normalise_timestamps(df.limit(0), "v").count() == 0


def brute(edges):
    out = {}
    for n in edges:
        path, at = [n], n
        while edges.get(at) is not None and edges[at] in edges and len(path) <= len(edges) + 1:
            at = edges[at]
            path.append(at)
        out[n] = (None, None, "") if len(path) > len(edges) else (path[-1], len(path) - 1, "/".join(map(str, reversed(path))))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_hierarchy_matches_walk(spark, seed):
    rng = random.Random(seed)
    n = 300
    edges = {k: rng.choice([None, rng.randrange(n + 20), k - 1 if k else None, 7]) for k in range(n)}
    df = spark.createDataFrame(list(edges.items()) + [(None, 3), (5, edges[5])], "node long, parent long")
    tree = resolve_hierarchy(df)
    got = {r["node"]: (r["root"], r["depth"], r["path"]) for r in tree.collect()}
    want = brute(edges)
    assert got == want
    below = {r["node"]: r["n_descendants"] for r in descendant_counts(tree).collect()}
    for k, (_, _, path) in want.items():
        if path:
            assert below[str(k)] == sum(1 for _, _, p in want.values() if str(k) in p.split("/")) - 1
    assert closure(tree).count() == sum(d for _, d, _ in want.values() if d)


def test_hierarchy_edges(spark):
    empty = resolve_hierarchy(spark.createDataFrame([], "node long, parent long"))
    assert empty.count() == 0
    meta = "page_id long, url string, metadata struct<parent_id:string>"
    rows = [(1, "https://A.example/x", None), (2, "https://b.example/y", (" 0001 ",)), (3, "https://b.example/z", ("HTTPS://a.EXAMPLE/x",)), (4, None, ("",)), (5, "u", ("5",)), (6, "v", ("99",)), (7, "w", ("https://a.example/X",)), (None, "q", ("1",))]
    got = {r["node"]: (r["named"], r["parent"]) for r in parent_edges(spark.createDataFrame(rows, meta)).collect()}
    assert got == {1: (False, None), 2: (True, 1), 3: (True, 1), 4: (False, None), 5: (True, 5), 6: (True, None), 7: (True, None)}
    tree = {r["node"]: r["depth"] for r in resolve_hierarchy(parent_edges(spark.createDataFrame(rows, meta))).collect()}
    assert tree == {1: 0, 2: 1, 3: 1, 4: 0, 5: None, 6: 0, 7: 0}


def test_closure_lists_descendants_and_circular_pages(spark, tmp_path):
    rows = [(1, "a", None), (2, "b", ("1",)), (3, "c", ("2",)), (4, "d", ("5",)), (5, "e", ("4",)), (6, "f", ("5",)), (7, "g", ("99",))]
    spark.createDataFrame(rows, "page_id long, url string, metadata struct<parent_id:string>").write.parquet(str(tmp_path / "page.parquet"))
    got = sorted(tuple(r) for r in QUERIES["p5_closure"](spark, str(tmp_path)).collect())
    assert got == [(-1, 4, -1), (-1, 5, -1), (-1, 6, -1), (1, 2, 1), (1, 3, 2), (2, 3, 1)]
