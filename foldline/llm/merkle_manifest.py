"""Merkle manifest of a dataset: one tree per source, one tree over the sources, a proof per row.

Leaves are numbered in their source by a range sort. A level is one window over blocks of runs: lag and lead columns at
fixed offsets, masked by the node's slot and by the length of its run, are its siblings, and the first child of a run
hashes the parent. Proofs go down again by joining each node with the path of its parent, sixteen times fewer rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldline.operators.series import null_safe_join, ordered_positions
from foldline.session import cut_lineage, discard

FANOUT = 16
#: Runs in one window partition: its rows are a constant number, whatever the size of a source.
BLOCK_RUNS = 16
PATH = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    """Unambiguous text of a value: its UTF-8 length, a colon and itself; a dash for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def with_siblings(nodes: DataFrame, only_parents: bool = False) -> DataFrame:
    """``nodes`` (tree, pos, n, digest, ...) with ``block``, ``run`` and the digests ``before`` and ``after`` each node in its
    run; ``parent`` is the run's hash on its first child. ``only_parents`` leaves out the siblings.
    """
    n = nodes.withColumns({"block": F.expr(f"pos div {FANOUT * BLOCK_RUNS}"), "run": F.expr(f"pos div {FANOUT}")})
    w = Window.partitionBy("tree", "block").orderBy("pos")
    slot = F.col("pos") % FANOUT
    size = F.least(F.lit(FANOUT), F.col("n") - F.col("pos") + slot)
    later = [F.when(slot + d < size, F.lead("digest", d).over(w)) for d in range(1, FANOUT)]
    after = F.concat_ws("", *later)
    if only_parents:
        return n.withColumn("after", after).filter(slot == 0).withColumn("parent", F.sha2(F.concat("digest", "after"), 256))
    earlier = [F.when(slot >= d, F.lag("digest", d).over(w)) for d in range(FANOUT - 1, 0, -1)]
    n = n.withColumns({"before": F.concat_ws("", *earlier), "after": after})
    return n.withColumn("parent", F.when(slot == 0, F.sha2(F.concat("digest", "after"), 256)))


def parents(first_children: DataFrame) -> DataFrame:
    return first_children.select("tree", F.col("run").alias("pos"), F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"), F.col("parent").alias("digest"))


def levels_above(nodes: DataFrame, height: int) -> tuple[list[DataFrame], DataFrame]:
    """Written levels (with siblings) of every tree that still has several nodes, and the roots (tree, digest) of all.

    ``nodes`` is the lowest level here, ``height`` the number of levels of the tallest tree above it.
    """
    levels, roots = [], []
    for _ in range(height):
        roots.append(nodes.filter("n = 1"))
        level = cut_lineage(with_siblings(nodes.filter("n > 1")))
        levels.append(level)
        nodes = parents(level.filter("parent IS NOT NULL"))
    roots.append(nodes.filter("n = 1"))
    found = roots[0]
    for r in roots[1:]:
        found = found.unionByName(r)
    return levels, found.select("tree", "digest")


def height_of(n: int) -> int:
    """Levels to hash until one of ``n`` nodes is left."""
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def down(level: DataFrame, upper: DataFrame) -> DataFrame:
    """Rows of ``level`` with the path of their parent behind their own siblings. One row of ``upper`` per run.

    The join is on the block, so that it keeps the partitioning of the level's window; a block has few runs.
    """
    up = upper.select(
        F.col("tree").alias("__tree"), F.expr(f"pos div {BLOCK_RUNS}").alias("__block"), F.col("pos").alias("__run"),
        F.col("path").alias("__path"), *[F.col(c).alias(f"__{c}") for c in ("subroot", "root")],
    )
    joined = level.join(up, (F.col("tree") == F.col("__tree")) & (F.col("block") == F.col("__block")) & (F.col("run") == F.col("__run")))
    own = F.array(F.struct("before", "after")).cast(PATH)
    return joined.withColumns({"path": F.concat(own, "__path"), "subroot": F.col("__subroot"), "root": F.col("__root")}).drop(*up.columns)


def paths(levels: list[DataFrame], tops: DataFrame) -> DataFrame:
    """(tree, pos, path, subroot, root) of every node of the lowest level; ``tops`` (tree, path, subroot, root) has the roots."""
    upper = tops.withColumn("pos", F.lit(0).cast("long"))
    at = upper
    for k in range(len(levels) - 1, -1, -1):
        here = down(levels[k], at).select("tree", "pos", "path", "subroot", "root")
        # trees that end at this level have no row in it
        ended = upper.join(levels[k].select("tree").distinct(), "tree", "left_anti").select("tree", "pos", "path", "subroot", "root")
        at = here.unionByName(ended)
    return at


def manifest(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns of each row with leaf, subroot, root and path.

    ``rows`` has ``source`` (null is a source), ``key`` (order in the source) and ``leaf`` (hex digest). path lists, from the
    leaf up, the digests before and after the node in its run; a run of one node has none, but is hashed. Rows with equal
    keys are ordered by leaf, so equal rows are interchangeable. A source of one row has its leaf as subroot, a dataset of
    one source its subroot as root. An empty table gives no rows. Only the largest source size and the number of sources
    reach the driver.
    """
    leaves = cut_lineage(rows.select("source", "key", "leaf", *[F.col(c).alias(f"k_{c}") for c in keep]))
    counted = cut_lineage(leaves.groupBy("source").agg(F.count("*").alias("n")))
    widest, sources = counted.agg(F.max("n"), F.count("*")).first()
    trees = cut_lineage(ordered_positions(counted, ["source"], out="tree"))
    nodes = null_safe_join(ordered_positions(leaves, ["key", "leaf"], ["source"]), trees, ["source"])
    nodes = nodes.select("tree", "pos", "n", F.col("leaf").alias("digest"), *[f"k_{c}" for c in keep])

    height = height_of(widest or 0)
    first = cut_lineage(parents(with_siblings(nodes.select("tree", "pos", "n", "digest").filter("n > 1"), only_parents=True)))
    levels, roots = levels_above(first, max(0, height - 1))
    lone = nodes.filter("n = 1").select("tree", "digest")
    subroots = cut_lineage(roots.unionByName(lone))

    one = subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(sources).cast("long").alias("n"), "digest")
    top_levels, top = levels_above(one, height_of(sources))
    crown = top.select("tree", F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    over = paths(top_levels, crown).select(F.col("pos").alias("tree"), "path", "root")
    tops = cut_lineage(over.join(subroots, "tree").select("tree", "path", F.col("digest").alias("subroot"), "root"))

    upper = cut_lineage(paths(levels, tops))
    discard(*levels, *top_levels)
    out = [*[F.col(f"k_{c}").alias(c) for c in keep], F.col("digest").alias("leaf"), "subroot", "root", "path"]
    many = down(with_siblings(nodes.filter("n > 1")), upper).select(*out)
    return many.unionByName(nodes.filter("n = 1").join(tops, "tree").select(*out))


def proof_text(path: Column) -> Column:
    """All siblings of a path, level by level from the leaf up, left to right."""
    return F.array_join(F.transform(path, lambda p: F.concat(p["before"], p["after"])), "")


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and the siblings of its path."""
    return F.aggregate(path, leaf, lambda at, p: F.sha2(F.concat(p["before"], at, p["after"]), 256))
