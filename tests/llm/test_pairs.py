"""Similar sets, near-duplicates and leaked passages against brute force, and edge cases."""

import random
import re
from collections import Counter
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from linkspark.llm.contamination import leaked_items
from linkspark.llm.near_duplicates import WORD, components, near_duplicate_groups, near_duplicates
from linkspark.llm.set_pairs import _keys, cell_links, expand_pairs, normal_items, pivot_cells, similar_between, similar_sets


def pairs(links, members):
    return sorted(map(tuple, expand_pairs(links.select("a", "b"), members).collect()))


def brute_sets(rows, t, least=3):
    sets = {k: {x for x in (re.sub(r"[-_\s]+", " ", y.lower()).strip() for y in v or [] if y is not None) if x} for k, v in rows if k is not None}
    sets = {k: s for k, s in sets.items() if len(s) >= least}
    return sorted((a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-9)


@pytest.mark.parametrize("seed,vocabulary,cover", [(0, 12, 0.2), (1, 40, 0.2), (2, 300, 0.1), (3, 9, 0.0)])
def test_similar_sets(spark, seed, vocabulary, cover):
    rng = random.Random(seed)
    base = [[f"t{rng.randrange(vocabulary)}" for _ in range(rng.randrange(1, 12))] for _ in range(60)]
    rows = []
    for k in range(220):
        tags = list(rng.choice(base))
        if rng.random() < 0.6 and tags:
            tags[rng.randrange(len(tags))] = f"t{rng.randrange(vocabulary)}"
        rows.append((k, [x.upper() if rng.random() < 0.2 else x for x in tags] + [None, "", " "]))
    rows += [(500, None), (501, []), (502, ["a-b", "a_b", "A  b "]), (503, ["k"] * 9)]
    df = spark.createDataFrame(rows + rows[:3], "rep long, tags array<string>").withColumn("items", F.lit("clash"))
    links, members = similar_sets(df, "rep", normal_items(F.col("tags")), 0.6, 3, cover)
    assert pairs(links, members) == brute_sets(rows, 0.6)


def test_similar_sets_hot_groups_and_edges(spark):
    rows = [(k, ["a", "b", "c"]) for k in range(30)] + [(k, ["a", "b", "c", "d"]) for k in range(30, 35)] + [(90, ["a", "b", "c", "d", "e"]), (91, ["x", "y", "z"])]
    df = spark.createDataFrame(rows, "id long, tags array<string>")
    links, members = similar_sets(df, "id", normal_items(F.col("tags")))
    assert links.count() == 3 and members.count() == len(rows) and pairs(links, members) == brute_sets(rows, 0.6)
    links, members = similar_sets(df.limit(0), "id", normal_items(F.col("tags")))
    assert links.count() == members.count() == 0
    with pytest.raises(ValueError):
        similar_sets(df, "id", normal_items(F.col("tags")), 0.5, 3, 0.5)


@pytest.mark.parametrize("threshold,cover,largest", [(0.6, 0.2, 60), (0.3, 0.1, 30), (0.8, 0.3, 5), (0.5, 0.0, 20)])
def test_similar_sets_of_any_size(spark, threshold, cover, largest):
    rng = random.Random(largest)
    rows = []
    for k in range(200):
        if rows and rng.random() < 0.6:
            tags = list(rng.choice(rows)[1])
            for _ in range(rng.randrange(0, 1 + len(tags) // 4)):
                tags[rng.randrange(len(tags))] = f"t{rng.randrange(400)}"
        else:
            tags = [f"t{rng.randrange(400)}" for _ in range(rng.randrange(1, largest))]
        rows.append((k, tags + ["hot"] * rng.randrange(2)))
    df = spark.createDataFrame(rows, "id long, tags array<string>")
    links, members = similar_sets(df, "id", normal_items(F.col("tags")), threshold, 1, cover)
    assert pairs(links, members) == brute_sets(rows, threshold, 1)


def test_every_link_of_sets_comes_from_a_cell(spark):
    """Each set is hosted once, within `cover` of its pivot, and a link lies in the cell that hosts its larger end."""
    rng = random.Random(9)
    base = [[f"t{rng.randrange(900)}" for _ in range(8)] for _ in range(60)]
    rows = [(k, [x if rng.random() < 0.9 else f"t{rng.randrange(900)}" for x in rng.choice(base)]) for k in range(300)]
    codes = sorted({tuple(sorted(set(t))) for _, t in rows})
    count = Counter(x for c in codes for x in c)
    code = {x: n for n, x in enumerate(count)}
    sized = [(k, [code[x] for x in sorted((x for x in c if count[x] > 1), key=lambda x: (count[x], code[x]))], len(c)) for k, c in enumerate(codes)]
    df = spark.createDataFrame([(k, o, n, len(o)) for k, o, n in sized if o], "id long, o array<long>, n int, m int")
    hosts, visits = pivot_cells(df, 0.6, 0.2)
    far = lambda a, b: 1 - len(set(codes[a]) & set(codes[b])) / len(set(codes[a]) | set(codes[b]))
    home = {r["id"]: r["pivot"] for r in hosts.collect()}
    assert hosts.count() == df.count() == len(home) and all(far(k, p) <= 0.2 + 1e-9 for k, p in home.items()) and len(set(home.values())) < len(home)
    links = cell_links(df, hosts, visits, 0.6).collect()
    assert all(home[r["b"]] == r["pivot"] for r in links)
    assert sorted((r["a"], r["b"]) for r in links) == [(a, b) for a in range(len(codes)) for b in range(a + 1, len(codes)) if far(a, b) <= 0.4 + 1e-9]


def test_large_sets_are_indexed_by_single_items(spark):
    rows = [(k, [f"t{k % 4}-{x}" if x % 12 else f"u{k}-{x}" for x in range(1000)]) for k in range(24)]
    df = spark.createDataFrame(rows, "id long, tags array<string>")
    links, members = similar_sets(df, "id", F.col("tags"))
    assert pairs(links, members) == brute_sets(rows, 0.6)
    o = spark.createDataFrame([(1, list(range(1000)), 1000, 1000)], "id long, o array<long>, n int, m int")
    assert _keys(o, Fraction(2, 5)).count() <= 1000


def test_similar_between_tables(spark):
    rng = random.Random(4)
    make = lambda: [(k, [f"t{rng.randrange(9)}" for _ in range(6)]) for k in range(60)]
    a, b = make(), make()
    df = lambda rows: spark.createDataFrame(rows, "id long, tags array<string>")
    got = sorted(map(tuple, similar_between(df(a), df(b), "id", normal_items(F.col("tags"))).collect()))
    want = sorted((i, j) for i, x in a for j, y in b if len(set(x)) >= 3 and len(set(y)) >= 3 and len(set(x) & set(y)) >= 0.6 * len(set(x) | set(y)) - 1e-9)
    assert got == want


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def joined(edges):
    home = {}
    for a, b in edges:
        both = home.setdefault(a, {a}) | home.setdefault(b, {b})
        for k in both:
            home[k] = both
    return sorted(list(x) for x in {tuple(sorted(v)) for v in home.values()})


def test_components(spark):
    rng = random.Random(5)
    path = [(k, k + 1) for k in range(300)] + [(1000 - k, 999 - k) for k in range(60)]
    edges = path + [(2000, k) for k in range(2001, 2200)] + [(rng.randrange(3000, 3200), rng.randrange(3000, 3200)) for _ in range(90)]
    edges = [(a, b) for a, b in edges if a != b]
    rows = components(spark.createDataFrame(edges + edges[:5] + [(7, 7)], "a long, b long")).collect()
    got = {}
    for r in rows:
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == joined(edges) and len(rows) == sum(map(len, got.values())) and all(k == min(v) for k, v in got.items())
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(4000)]
    rows, k = [], 0
    for _ in range(25):
        text = [rng.choice(words) for _ in range(rng.randrange(40, 300))]
        for _ in range(5):
            copy = list(text)
            for _ in range(rng.randrange(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((k, " ".join(copy)))
            k += 1
    rows += [(1000, None), (1001, ""), (1002, "one two three four"), (1003, "一二三四五六七"), (1004, "一二三四五六七"), (1005, "A b\nc  D e"), (1006, "a B c d\n\nE"), (1007, "long " * 200_000), (1008, "long " * 100_000)]
    df = spark.createDataFrame(rows, "mark long, text string").withColumn("id", F.lit("clash"))
    links, members = near_duplicates(df, "mark", "text", 0.7)
    sets = {i: shingles(t) for i, t in rows}
    want = sorted((a, b) for a in sets for b in sets if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b]))
    assert pairs(links, members) == want and (1003, 1004) in want and (1005, 1006) in want and (1007, 1008) in want
    got = {}
    for r in near_duplicate_groups(links, members).collect():
        got.setdefault(r["group"], set()).add(r["id"])
    assert sorted(map(sorted, got.values())) == joined(want) and all(k == min(v) for k, v in got.items())
    links, members = near_duplicates(df.limit(0), "mark", "text")
    assert links.count() == members.count() == 0


def test_leaked_items(spark):
    rng = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron".split()
    items = [(k, " ".join(rng.choice(words) for _ in range(30)), " ".join(rng.choice(words) for _ in range(rng.randrange(5, 20)))) for k in range(12)] + [(50, None, ""), (51, "too short", None)]
    docs = []
    for k in range(150):
        text = [rng.choice(words) for _ in range(60)]
        if k % 3 == 0:
            source = rng.choice(items[:12])[rng.choice([1, 2])].split()
            n = rng.randrange(8, 20)
            at = rng.randrange(max(1, len(source) - n + 1))
            text[20:20] = source[at : at + n]
        docs.append((k, rng.choice([" ", "_", "\n+", " - "]).join(text).upper() if k % 2 else " ".join(text)))
    docs += [(900, None), (901, ""), (902, items[0][1]), (902, items[0][1]), (903, "x " * 100_000 + items[1][1] + " y" * 10)]
    ddf = spark.createDataFrame(docs, "doc long, t string").withColumn("code", F.lit(1))
    idf = spark.createDataFrame(items + items[:1], "item long, prompt string, answer string")
    run = re.compile(r"[^\W_]+")
    windows = {}
    for k, p, a in items:
        for t in (p, a):
            w = run.findall((t or "").lower())
            for n in range(len(w) - 11):
                windows.setdefault(tuple(w[n : n + 12]), set()).add(k)
    want = set()
    for d, t in docs:
        w = run.findall((t or "").lower())
        for n in range(len(w) - 11):
            want |= {(d, k) for k in windows.get(tuple(w[n : n + 12]), ())}
    for limit in (2_000_000, 0):  # with the items' shingles sent to the tasks, and joined
        got = [(r["doc_id"], r["item_id"]) for r in leaked_items(ddf, "doc", "t", idf, "item", ["prompt", "answer"], broadcast_rows=limit).collect()]
        assert len(got) == len(set(got)) and set(got) == want and (902, 0) in want and (903, 1) in want
    assert leaked_items(ddf.limit(0), "doc", "t", idf, "item", ["prompt"]).count() == 0
    assert leaked_items(ddf, "doc", "t", idf.limit(0), "item", ["prompt"]).count() == 0
