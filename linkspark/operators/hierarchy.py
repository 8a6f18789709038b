"""Turn parent-child rows into full hierarchies by pointer doubling.

Every unresolved node holds a pointer to an ancestor and the path segment
between the two.  A round joins the pointer to that ancestor's own state, which
doubles the jump: after round k all nodes of depth up to 2^k are resolved, so a
tree of depth D needs log2(D) rounds.  If some acyclic node were still open,
its ancestry would hold a node that the round resolves; a round that resolves
nothing therefore proves that all open nodes lie on cycles or below them.

Rounds exchange only (node, pointer, segment) of open nodes.  A hot parent skews
only the pointer side of the join, whose other side is unique by node, so
adaptive skew splitting applies.  Each round is a table in the shared folder.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspark.workspace import materialise

BLANK = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def url_key(url: Column) -> Column:
    """The url without surrounding blanks and with scheme and host in lower case."""
    clean = F.regexp_replace(url, BLANK, "")
    head = F.regexp_extract(clean, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", 0)
    return F.concat(F.lower(head), F.substring(clean, F.length(head) + 1, F.length(clean)))


def parent_edges(page: DataFrame) -> DataFrame:
    """(node, named, parent): for each distinct page_id whether it names a parent
    and the parent's page_id, null if it names none or one that is not there.

    Rows without page_id are left out.  Of rows that repeat a page_id the
    smallest non-blank parent name counts; of pages that share a url the
    smallest page_id is meant."""
    name = F.regexp_replace(F.col("metadata.parent_id"), BLANK, "")
    digits = F.regexp_replace(name, "^0+(?=[0-9])", "")
    key = F.when(name.rlike("^[0-9]+$"), F.concat(F.lit("i"), digits)).when(name != "", F.concat(F.lit("u"), url_key(name)))
    nodes = page.where("page_id is not null").select(F.col("page_id").alias("node"), key.alias("key"), url_key(F.col("url")).alias("url"))
    by_id = nodes.groupBy("node").agg(F.min("key").alias("key"))
    lookup = nodes.select(F.concat(F.lit("i"), F.col("node").cast("string")).alias("key"), F.col("node").alias("parent"))
    named_url = nodes.where("url <> ''").select(F.concat(F.lit("u"), F.col("url")).alias("key"), F.col("node").alias("parent"))
    lookup = lookup.unionByName(named_url).groupBy("key").agg(F.min("parent").alias("parent"))
    # pages without a name don't take part in the join, where they would be one hot key
    plain = by_id.where("key is null").select("node", F.lit(False).alias("named"), F.lit(None).cast(dict(nodes.dtypes)["node"]).alias("parent"))
    return by_id.where("key is not null").join(lookup, "key", "left").select("node", F.lit(True).alias("named"), "parent").unionByName(plain)


def resolve_hierarchy(edges: DataFrame, node: str = "node", parent: str = "parent", sep: str = "/") -> DataFrame:
    """(node, root, depth, path) for each distinct node of ``edges``.

    ``parent`` null, or naming no node of the table, makes a root of depth 0 whose
    path is its own id.  Nodes on a cycle or below one get root and depth null and
    an empty path (a node that is its own parent is a cycle).  Null nodes are left
    out, of repeated nodes the smallest non-null parent counts; an empty table
    gives an empty result."""
    base = edges.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("node")).agg(F.min(parent).alias("parent"))
    ids = base.select(F.col("node").alias("parent"), F.lit(True).alias("there"))
    start = lambda df, anc: df.select("node", anc.alias("anc"), F.col("node").cast("string").alias("seg"), F.lit(1).alias("hops"))
    bare = start(base.where("parent is null"), F.col("parent"))
    first = materialise(start(base.where("parent is not null").join(ids, "parent", "left"), F.when(F.col("there"), F.col("parent"))).unionByName(bare), "tree-0")
    done = [first.where("anc is null").select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.col("seg").alias("path"))]
    open_, k, kind = first.where("anc is not null"), 0, dict(first.dtypes)["node"]
    while True:
        k += 1
        found = reduce(DataFrame.unionByName, done)
        at = found.select(F.col("node").alias("anc"), "root", "depth", F.col("path").alias("above"), F.lit(None).cast(kind).alias("next"), F.lit(0).alias("more"))
        on = open_.select(F.col("node").alias("anc"), F.lit(None).cast(kind).alias("root"), F.lit(None).cast("int").alias("depth"), F.col("seg").alias("above"), F.col("anc").alias("next"), F.col("hops").alias("more"))
        step = open_.join(at.unionByName(on), "anc").select(
            "node", "root", (F.col("depth") + F.col("hops")).alias("depth"), F.concat_ws(sep, "above", "seg").alias("seg"), F.col("next").alias("anc"), (F.col("hops") + F.col("more")).alias("hops"))
        step = materialise(step, f"tree-{k}")
        row = step.agg(F.count(F.when(F.col("root").isNotNull(), 1)).alias("new"), F.count(F.when(F.col("root").isNull(), 1)).alias("left")).first()
        if row["new"]:
            done.append(step.where("root is not null").select("node", "root", "depth", F.col("seg").alias("path")))
        open_ = step.where("root is null").select("node", "anc", "seg", "hops")
        if not row["left"]:
            break
        if not row["new"]:
            done.append(open_.select("node", F.lit(None).cast(kind).alias("root"), F.lit(None).cast("int").alias("depth"), F.lit("").alias("path")))
            break
    return reduce(DataFrame.unionByName, done)


def descendant_counts(tree: DataFrame, sep: str = "/") -> DataFrame:
    """(node, n_descendants) of nodes outside cycles.  Paths are exploded into
    (ancestor, 1) and combined before the shuffle, so a root above a third of all
    rows costs one partial sum a task."""
    up = tree.where("path <> ''").select(F.explode(F.split("path", sep)).alias("node"))
    return up.groupBy("node").agg((F.count("*") - 1).alias("n_descendants"))


def closure(tree: DataFrame, sep: str = "/") -> DataFrame:
    """(ancestor, node, steps): every ancestor of every node outside cycles."""
    return tree.where("path <> ''").select("node", F.posexplode(F.split("path", sep)).alias("at", "ancestor"), "depth").where("at < depth").select(
        F.col("ancestor"), "node", (F.col("depth") - F.col("at")).alias("steps"))
