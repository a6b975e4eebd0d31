"""Approximate nearest neighbours by inner product from several shifted Hilbert orderings."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.llm.common import hash_sample
from foldline.session import cut_lineage

ORDERINGS, DIMENSIONS, BITS = 16, 8, 7
#: Bounds: vectors that the projections are scaled on, queries whose true neighbours set the window, vectors of a task.
SCALE_ROWS, TUNE_QUERIES, BLOCK_ROWS = 4_096, 200, 20_000
#: Share of the true neighbours of the tuning queries that the windows must hold.
TARGET = 0.97


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Positions of grid cells (n x d, unsigned) along the Hilbert curve, as one number each (bits * d <= 63)."""
    x = cells.astype(np.uint64).T.copy()
    d, one = len(x), np.uint64(1)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        low = q - one
        for i in range(d):
            set_ = (x[i] & q) > 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
    for i in range(1, d):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.uint64)
    for level in range(bits - 1, 0, -1):
        q = one << np.uint64(level)
        flip ^= np.where((x[d - 1] & q) > 0, q - one, np.uint64(0))
    x ^= flip
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << one | (x[i] >> np.uint64(b)) & one
    return key.astype(np.int64)


def usable(vector: Column) -> Column:
    """Not null, not all zero, every component finite."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def vector_classes(vectors: DataFrame, k: int) -> DataFrame:
    """(node, vec, ids): one row per distinct vector, node its smallest id, ids its k + 1 smallest: ties never need more."""

    def run(batches):
        for rows in batches:
            p = pd.DataFrame({"vec": [np.asarray(v, np.float64).tobytes() for v in rows.column(1).to_pylist()], "id": rows.column(0).to_numpy()})
            if len(p):
                g = p.sort_values("id").groupby("vec", sort=False)["id"].apply(lambda x: x.iloc[: k + 1].tolist())
                yield pa.RecordBatch.from_arrays([pa.array(g.index.tolist(), pa.binary()), pa.array(g.tolist(), pa.list_(pa.int64()))], names=["vec", "ids"])

    part = vectors.select("id", F.transform("v", lambda x: x.cast("double") + 0.0).alias("v")).mapInArrow(run, "vec binary, ids array<long>")
    ids = F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k + 1)
    return part.groupBy("vec").agg(ids.alias("ids")).select(F.element_at("ids", 1).alias("node"), "vec", "ids")


def orderings(classes: DataFrame, vectors: int, seed: int = 7) -> DataFrame:
    """(t, node, pos): place of each class in each of the shifted Hilbert orderings.

    Each ordering has its own random projection to ``DIMENSIONS`` axes, scaled on a bounded sample, and its own shift of
    the grid. All orderings are range-partitioned and sorted together; a place is the row's number in its partition
    plus the counts of the partitions before.
    """
    spark = classes.sparkSession
    sample = np.array([np.frombuffer(r["vec"]) for r in hash_sample(classes, ["node"], SCALE_ROWS).select("vec").collect()])
    rng = np.random.default_rng(seed)
    turn = rng.normal(size=(ORDERINGS, sample.shape[1], DIMENSIONS))
    seen = np.einsum("nd,tdk->tnk", sample, turn)
    mean, spread = seen.mean(axis=1), np.maximum(seen.std(axis=1), 1e-12)
    shift = rng.uniform(-0.5, 0.5, (ORDERINGS, DIMENSIONS))

    def keys(batches):
        for rows in batches:
            x = np.array([np.frombuffer(v) for v in rows.column(1).to_pylist()])
            for t in range(ORDERINGS if len(x) else 0):
                y = (x @ turn[t] - mean[t]) / spread[t] + shift[t]
                cells = np.clip((y + 4) / 8 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t)), pa.array(hilbert_keys(cells)), rows.column(0)], names=["t", "key", "node"])

    def number(batches):
        part, seen_rows = TaskContext.get().partitionId(), np.zeros(ORDERINGS, np.int64)
        for rows in batches:
            t = rows.column(0).to_numpy()
            nth = np.zeros(len(t), np.int64)
            for one in np.unique(t):
                mine = t == one
                nth[mine] = seen_rows[one] + np.arange(mine.sum())
                seen_rows[one] += mine.sum()
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(np.full(len(t), part)), pa.array(nth)], names=["t", "node", "part", "nth"])

    parts = max(ORDERINGS, vectors * ORDERINGS // 200_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keyed = classes.select("node", "vec").mapInArrow(keys, "t long, key long, node long")
    placed = cut_lineage(keyed.repartitionByRange(parts, "t", "key", "node").sortWithinPartitions("t", "key", "node").mapInArrow(number, "t long, node long, part long, nth long"))
    before = placed.groupBy("t", "part").agg(F.count("*").alias("n")).selectExpr("t", "part", "sum(n) OVER (PARTITION BY t ORDER BY part) - n AS earlier")
    return cut_lineage(placed.join(before, ["t", "part"]).select("t", "node", (F.col("earlier") + F.col("nth")).alias("pos")))


def _top(query: np.ndarray, base: np.ndarray, nodes: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and scores of the k + 1 best rows of ``base`` for one query, ties to smaller nodes; scores summed in one fixed order."""
    rough = base @ query
    near = rough >= np.partition(rough, -min(k + 1, len(rough)))[-min(k + 1, len(rough))] - 1e-9 * (1 + np.abs(rough).max())
    exact = (base[near] * query).sum(axis=1)
    order = np.lexsort((nodes[near], -exact))[: k + 1]
    return nodes[near][order], exact[order]


def _exact_neighbours(classes: DataFrame, queries: list, k: int) -> list[tuple[int, int]]:
    """(query node, neighbour node) of the true nearest classes of a few queries, block by block over all rows."""
    q = np.array([np.frombuffer(r["vec"]) for r in queries])
    names = [r["node"] for r in queries]

    def run(batches):
        for rows in batches:
            base, nodes = np.array([np.frombuffer(v) for v in rows.column(1).to_pylist()]), rows.column(0).to_numpy()
            for name, x in zip(names, q) if len(nodes) else ():
                got, score = _top(x, base, nodes, name, k)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(got)), pa.array(got), pa.array(score)], names=["q", "node", "score"])

    best = classes.select("node", "vec").mapInArrow(run, "q long, node long, score double")
    best = best.selectExpr("q", "node", "row_number() OVER (PARTITION BY q ORDER BY score DESC, node) AS r").filter(F.col("r") <= k + 1)
    return [(r["q"], r["node"]) for r in best.collect() if r["q"] != r["node"]]


def window_size(classes: DataFrame, places: DataFrame, k: int, target: float = TARGET) -> int:
    """Half-width of the windows so that they hold ``target`` of the true neighbours of a bounded sample of queries."""
    queries = hash_sample(classes, ["vec"], TUNE_QUERIES).select("node", "vec").collect()
    pairs = _exact_neighbours(classes, queries, k)
    if not pairs:
        return 1
    p = classes.sparkSession.createDataFrame(pairs, "q long, node long")
    a = places.select(F.col("node").alias("q"), "t", F.col("pos").alias("p"))
    far = p.join(places, "node").join(a, ["q", "t"]).groupBy("q", "node").agg(F.min(F.abs(F.col("p") - F.col("pos"))).alias("far"))
    return int(np.quantile([r["far"] for r in far.collect()], target, method="higher")) + 1


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, target: float = TARGET) -> DataFrame:
    """(query_id, rank, vec_id, score): up to ``k`` nearest rows of ``vectors`` (id, v) for each id of ``queries`` (id).

    Nearness is the inner product in double precision, ties go to the smaller id, the query's own id is no candidate.
    Equal vectors form one class, and only classes are placed and compared. Every class has a place in each
    ordering; a query is compared with all classes within a window around its places, whose width is set by the recall of
    a bounded sample of queries against all rows. Vectors that are null, zero, hold null or non-finite components, or
    have another length than most take no part, as candidates or queries; neither do null ids.
    """
    spark = vectors.sparkSession
    good = vectors.filter(F.col("id").isNotNull() & usable(F.col("v"))).select(F.col("id").cast("long").alias("id"), "v")
    size = good.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    good = good.filter(F.size("v") == (size[0]["d"] if size else 0))
    classes = cut_lineage(vector_classes(good, k))
    n = classes.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    packed = good.select("id", F.transform("v", lambda x: x.cast("double") + 0.0).alias("v"))

    def as_bytes(batches):
        for rows in batches:
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([np.asarray(v, np.float64).tobytes() for v in rows.column(1).to_pylist()], pa.binary())], names=["id", "vec"])

    asked = packed.join(queries.select(F.col("id").cast("long").alias("id")).distinct(), "id", "left_semi").mapInArrow(as_bytes, "id long, vec binary")
    members = cut_lineage(asked.join(classes.select("node", "vec"), "vec").select("node", F.col("id").alias("query_id")))
    places = orderings(classes, n)
    half = window_size(classes, places, k, target)
    block = min(max(half, 256), BLOCK_ROWS)

    with_vec = places.join(classes.select("node", "vec"), "node")
    base = with_vec.select("t", (F.col("pos") / block).cast("long").alias("block"), F.lit(False).alias("asks"), "node", "vec", "pos")
    reach = F.sequence(F.greatest((F.col("pos") - half) / block, F.lit(0)).cast("long"), ((F.col("pos") + half) / block).cast("long"))
    ask = with_vec.join(members.select("node").distinct(), "node", "left_semi").select("t", F.explode(reach).alias("block"), F.lit(True).alias("asks"), "node", "vec", "pos")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        rows, q = pdf[~pdf["asks"]], pdf[pdf["asks"]]
        out = []
        if len(rows) and len(q):
            x, nodes, pos = np.array([np.frombuffer(v) for v in rows["vec"]]), rows["node"].to_numpy(), rows["pos"].to_numpy()
            for node, vec, at in zip(q["node"], q["vec"], q["pos"]):
                inside = np.abs(pos - at) <= half
                if inside.any():
                    out.append((node, *(v.tolist() for v in _top(np.frombuffer(vec), x[inside], nodes[inside], node, k))))
        return pd.DataFrame(out, columns=["q", "nodes", "scores"])

    found = base.union(ask).groupBy("t", "block").applyInPandas(compare, "q long, nodes array<long>, scores array<double>")
    pairs = found.select("q", F.explode(F.arrays_zip("nodes", "scores")).alias("x")).select("q", F.col("x.nodes").alias("node"), F.col("x.scores").alias("score")).distinct()
    best = pairs.selectExpr("*", "row_number() OVER (PARTITION BY q ORDER BY score DESC, node) AS r").filter(F.col("r") <= k + 1)
    lists = best.join(classes.select("node", "ids"), "node").select("q", "score", F.explode("ids").alias("vec_id")).groupBy("q").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))), 1, k + 1).alias("list")
    )
    merged = members.join(cut_lineage(lists), F.col("node") == F.col("q")).select("query_id", F.filter("list", lambda x: x["vec_id"] != F.col("query_id")).alias("list"))
    return merged.select("query_id", F.posexplode(F.slice("list", 1, k))).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), (-F.col("col.less")).alias("score"))
