"""All similar pairs of set-valued records by metric pivot partitioning.

Jaccard distance d = 1 - J is a metric.  With the wanted distance t:

1. Equal sets collapse into one representative, so copies cost nothing.
2. Pivots.  For each item that is the rarest shared item of some set, one such
   set is a pivot.  Of the sets farther than ``cover`` from all of these, those
   with the smallest hash among their like within ``cover`` become pivots, and
   what still is uncovered becomes a pivot of a cell of its own.
3. Cells.  Each set is hosted by the cell of its nearest pivot, at most ``cover``
   away.  A cell's radius is the distance of its farthest host.
4. Replication.  If h is hosted by cell q and d(r, h) <= t, then
   d(r, q) <= t + d(h, q): r visits cell q if that holds for the cell's radius.
5. Exact join within the cells, with |d(r, q) - d(h, q)| <= t tested first and
   d(r, q) + d(h, q) <= t accepted without a look at the sets.  The pair (r, h)
   is reported from the cell of the larger id only, so no distinct is needed.

Every link between different sets comes from a cell.  Distances to pivots are
sparse: all but those of sets with common items are 1 and never asked for, as
``cover`` + ``cover`` + t is below 1 or else covers nothing.  So a set meets its pivots through
its items (:func:`_near`): sets with J >= tau share c = ceil(tau * n) items, hence
one of the first n - c + 1 in rarity order, and if c > 1 two of the first n - c + 2.
Small sets are indexed by pairs of items, larger ones by single items, so a set's keys
never grow faster than its size.

Items are compared by 64-bit hashes.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.workspace import materialise


def normal_items(items: Column) -> Column:
    """Lower-cased items with runs of ``-``, ``_`` and blanks as one space, trimmed,
    without nulls, empty items and repeats."""
    clean = F.transform(items, lambda x: F.trim(F.regexp_replace(F.lower(x), r"[-_\s\p{Z}]+", " ")))
    return F.array_sort(F.array_distinct(F.filter(clean, lambda x: x.isNotNull() & (x != ""))))


def _ceil(x: Fraction, n: str) -> str:
    return f"cast(({n} * {x.numerator} + {x.denominator - 1}) div {x.denominator} as int)"


#: Sets of up to this size are indexed by pairs of items.
PAIRED = 16


def _keys(sets: DataFrame, tau: Fraction) -> DataFrame:
    """(id, o, n, m, key, i, j, paired): the items, and the pairs of items, under which a set is
    indexed.  With c items common to any partner they are among the first m - c + 1 (one item) or
    m - c + 2 (two) of its m shared items.  A set that can have partners on either side of ``PAIRED`` has both."""
    last, need = f"(m - greatest({_ceil(tau, 'n')}, 2) + 1)", f"(m - greatest({_ceil(tau, 'n')}, 1))"
    pairs = (
        f"flatten(transform(sequence(0, {last} - 1), i -> transform(sequence(i + 1, {last}), "
        "j -> named_struct('key', xxhash64(o[i], o[j]), 'i', i, 'j', j, 'paired', true))))"
    )
    single = f"transform(sequence(0, {need}), i -> named_struct('key', o[i], 'i', i, 'j', i, 'paired', false))"
    none = "cast(array() AS array<struct<key:bigint,i:int,j:int,paired:boolean>>)"
    # partners that are both small have one item in common at least, both larger ones than PAIRED too
    by_one = f"n * {tau.numerator} <= {tau.denominator} OR n * {tau.denominator} > {PAIRED} * {tau.numerator}"
    keys = f"concat(if(n <= {PAIRED} AND {last} >= 1, {pairs}, {none}), if(({by_one}) AND {need} >= 0, {single}, {none}))"
    return sets.selectExpr("id", "o", "n", "m", f"inline({keys})")


def _near(sets: DataFrame, pivots: DataFrame, tau: Fraction) -> DataFrame:
    """(id, pivot, d): sets and pivots with J >= tau and their distance d = 1 - J."""
    a, b = _keys(sets, tau).alias("a"), _keys(pivots, tau).alias("b")
    both = tau.numerator + tau.denominator
    # the items from the first common one on must be enough
    need = f"(a.n + b.n) * {tau.numerator} <= (least(a.m - a.j, b.m - b.j) + if(a.paired, 1, 0)) * {both}"
    length = f"a.n * {tau.denominator} >= b.n * {tau.numerator} AND b.n * {tau.denominator} >= a.n * {tau.numerator}"
    # pairs of items serve where two must be common and neither set is large, single items elsewhere
    by_pair = f"greatest(a.n, b.n) * {tau.numerator} > {tau.denominator} AND greatest(a.n, b.n) <= {PAIRED}"
    found = a.join(b, F.expr(f"a.key = b.key AND a.paired = b.paired AND a.paired = ({by_pair}) AND {length} AND {need}")).selectExpr(
        "a.id", "b.id AS pivot", "array_intersect(a.o, b.o) AS x", "a.n + b.n AS both_n", "a.o[a.i] AS t1", "a.o[a.j] AS t2", "a.paired")
    # a pair is taken at its first common items only
    found = found.where("x[0] = t1 AND (NOT paired OR x[1] = t2)").selectExpr("id", "pivot", "size(x) AS k", "both_n")
    return found.where(f"k * {both} >= both_n * {tau.numerator}").selectExpr("id", "pivot", "1 - k / (both_n - k) AS d")


def pivot_cells(sized: DataFrame, threshold: float, cover: float) -> tuple[DataFrame, DataFrame]:
    """``(hosts, visits)`` of ``sized(id, o, n, m)``: ``hosts(pivot, id, d)`` has each set once, with its
    nearest pivot, ``visits(pivot, id, d)`` every set in every cell that may hold a partner of it."""
    tau, close = Fraction(str(threshold)), 1 - Fraction(str(cover))
    low = tau - Fraction(str(cover))
    t = 1 - threshold + 1e-9
    first = sized.where("m > 0").groupBy(F.element_at("o", 1).alias("item")).agg(F.min(F.struct("id", "o", "n", "m")).alias("s")).select("s.*")
    near = materialise(_near(sized, first, low), "near")
    nearest = lambda df: df.groupBy("id").agg(F.min(F.struct("d", "pivot")).alias("h")).select("h.pivot", "id", "h.d").where(F.col("d") <= cover + 1e-9)
    home = nearest(near)
    left = materialise(sized.join(home.select("id"), "id", "left_anti"), "uncovered")
    # a second layer over the rest: those before all their like within `cover`, by hash, then what is left
    like = materialise(_near(left, left, close).where("id <> pivot"), "like")
    order = lambda c: F.struct(F.xxhash64(c), F.col(c))
    behind = like.where(order("pivot") < order("id")).select("id").distinct()
    second = like.join(behind.select(F.col("id").alias("pivot")), "pivot", "left_anti").where(order("pivot") < order("id"))
    second_home = nearest(second.select("pivot", "id", "d"))
    own = left.select("id").join(second_home.select("id"), "id", "left_anti").select(F.col("id").alias("pivot"), "id", F.lit(0.0).alias("d"))
    hosts = materialise(home.unionByName(second_home).unionByName(own), "hosts")
    radius = hosts.groupBy("pivot").agg(F.max("d").alias("r"))
    # visits of the second layer's cells: those of radius 0 reach as far as t, the others as far as t + cover
    later = radius.join(first.select(F.col("id").alias("pivot")), "pivot", "left_anti").withColumnRenamed("pivot", "id")
    cells = lambda which: sized.join(later.where(which).select("id"), "id", "left_semi")
    reach = near.unionByName(_near(sized, cells("r = 0"), tau)).unionByName(_near(sized, cells("r > 0"), low))
    return hosts, reach.join(radius, "pivot").where(F.col("d") <= F.col("r") + t).select("pivot", "id", "d")


def similar_sets(records: DataFrame, id_col: str, items: Column, threshold: float = 0.6, min_size: int = 1, cover: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """``(links, members)``: ``links(a, b)`` holds each pair of different sets, a < b,
    with J >= threshold; ``members(rep, id)`` holds every record with its set's
    representative, the smallest id that has the set.

    Records with a null id, a null array or fewer than ``min_size`` different items (an empty set
    is like no other)
    are left out, and repeated rows count once.  ``cover`` must lie below ``threshold``.  Other columns
    are ignored; an empty table gives empty results.  Neither partners nor candidates
    are capped."""
    tau = Fraction(str(threshold))
    if not 0 <= cover < threshold <= 1:
        raise ValueError("cover must lie below the threshold, and that between 0 and 1")
    base = records.select(F.col(id_col).alias("id"), items.alias("items")).where("id is not null").where(F.size("items") >= max(min_size, 1))
    sets = base.groupBy("items").agg(F.min("id").alias("rep"))
    members = base.join(sets, "items").select("rep", "id").distinct()

    cells = sets.select("rep", F.size("items").alias("n"), F.explode("items").alias("item")).select("rep", "n", F.xxhash64("item").alias("item"))
    freq = cells.groupBy("item").agg(F.count("*").alias("df")).where("df > 1")
    # an item of one set only is common to no pair: it counts in the set's size and nowhere else
    ordered = cells.join(freq, "item").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("df", "item"))).alias("o"), F.first("n").alias("n"))
    sized = materialise(ordered.select(F.col("rep").alias("id"), F.transform("o", lambda x: x["item"]).alias("o"), "n", F.size("o").alias("m")), "sets")
    return cell_links(sized, *pivot_cells(sized, threshold, cover), threshold).select("a", "b"), members


def cell_links(sized: DataFrame, hosts: DataFrame, visits: DataFrame, threshold: float) -> DataFrame:
    """(pivot, a, b) of the pairs of a visitor a and a host b > a of each cell with J >= threshold."""
    tau, t = Fraction(str(threshold)), 1 - threshold + 1e-9
    guests = visits.join(sized, "id").select("pivot", F.col("id").alias("a"), F.col("d").alias("da"), F.col("o").alias("oa"), F.col("n").alias("na"))
    homes = hosts.join(sized, "id").select("pivot", F.col("id").alias("b"), F.col("d").alias("db"), F.col("o").alias("ob"), F.col("n").alias("nb"))
    pairs = guests.join(homes, "pivot").where(f"a < b AND abs(da - db) <= {t} AND da <= db + {t}")
    exact = f"size(array_intersect(oa, ob)) * {tau.numerator + tau.denominator} >= (na + nb) * {tau.numerator}"
    return pairs.where(f"da + db <= {t - 2e-9} OR {exact}").select("pivot", "a", "b")


def expand_pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: the record pairs of linked sets and those of equal ones."""
    a = members.select(F.col("rep").alias("a"), F.col("id").alias("x"))
    b = members.select(F.col("rep").alias("b"), F.col("id").alias("y"))
    across = links.join(a, "a").join(b, "b").select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    equal = a.join(b, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select(F.col("x").alias("id_a"), F.col("y").alias("id_b"))
    return across.unionByName(equal)


def similar_between(left: DataFrame, right: DataFrame, id_col: str, items: Column, threshold: float = 0.6, min_size: int = 1) -> DataFrame:
    """(left_id, right_id) of records in two tables with J >= threshold; ids may repeat
    between the tables.  Null and small sets are treated as in :func:`similar_sets`."""
    side = lambda df, s: df.select(F.struct(F.col(id_col).alias("v"), F.lit(s).alias("s")).alias("key"), F.col(id_col).alias("own"), items.alias("items")).where("own is not null")
    both = side(left, 0).unionByName(side(right, 1))
    links, members = similar_sets(both, "key", F.col("items"), threshold, min_size)
    links = materialise(links, "links")
    every = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(members.select(F.col("rep").alias("a"), F.col("rep").alias("b")).distinct())
    one = members.where("id.s = 0").select(F.col("rep").alias("a"), F.col("id.v").alias("left_id"))
    two = members.where("id.s = 1").select(F.col("rep").alias("b"), F.col("id.v").alias("right_id"))
    return every.join(one, "a").join(two, "b").select("left_id", "right_id")
