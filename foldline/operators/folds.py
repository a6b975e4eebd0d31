"""Fold assignment as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.operators.digests import row_differences, same_rows
from foldline.operators.series import ordered_positions
from foldline.session import cut_lineage


def hash_key(id: Column, seed: int) -> Column:
    """Reproducible shuffle key: md5 of id and seed as text."""
    return F.md5(F.concat_ws(":", id.cast("string"), F.lit(str(seed))))


def _contiguous(pos: Column, n: int, k: int) -> Column:
    size, extra = divmod(n, k)
    long = extra * (size + 1)
    return F.when(pos < long, F.floor(pos / (size + 1))).otherwise(F.lit(extra) + F.floor((pos - long) / max(size, 1))).cast("int")


def kfold(df: DataFrame, k: int, order: Sequence[str] = (), id: str | None = None, shuffle: bool = False, seed: int = 42) -> DataFrame:
    """Folds 0..k-1 of contiguous positions (the first ones a row longer), or of a hash order."""
    n = df.count()
    if shuffle:
        placed = ordered_positions(df.withColumn("__key", hash_key(F.col(id), seed)), ["__key", id], out="__pos").drop("__key")
    else:
        placed = ordered_positions(df, order, out="__pos")
    return placed.withColumn("fold", _contiguous(F.col("__pos"), n, k)).drop("__pos")


def stratified_kfold(df: DataFrame, y: str, k: int, id: str, seed: int = 42) -> DataFrame:
    """Each class is dealt over the folds in hash order."""
    keyed = df.withColumn("__key", hash_key(F.col(id), seed))
    placed = ordered_positions(keyed, ["__key", id], [y], "__pos")
    return placed.withColumn("fold", (F.col("__pos") % k).cast("int")).drop("__pos", "__key")


def _stages(loads: list[int], weight: int, count: int) -> list[tuple[int, list[int]]]:
    """How ``count`` equal weights fall on folds that always take the lightest one.

    Returns ``(first position, cycle of folds)`` stages; ``loads`` is updated in place.
    """
    k = len(loads)
    start = list(loads)
    taken = [0] * k
    stages: list[tuple[int, list[int]]] = []
    at = 0
    levels = sorted(set(start))
    for i, level in enumerate(levels):
        active = [f for f in range(k) if start[f] <= level]
        cycle = sorted(active, key=lambda f: (start[f] + taken[f] * weight, f))
        stages.append((at, cycle))
        if i + 1 < len(levels):
            upper = levels[i + 1]
            room = {f: max(0, -(-(upper - start[f]) // weight) - taken[f]) for f in active}
            total = sum(room.values())
            if at + total < count:
                for f in active:
                    taken[f] += room[f]
                at += total
                continue
        rest = count - at
        for j, f in enumerate(cycle):
            taken[f] += rest // len(cycle) + (1 if j < rest % len(cycle) else 0)
        break
    for f in range(k):
        loads[f] += taken[f] * weight
    return stages


def group_kfold(counts: DataFrame, group: str, weight: str, k: int) -> DataFrame:
    """Heaviest group first onto the lightest fold; equal weights from the larger name down. Folds from 1.

    Only the histogram of distinct weights visits the driver (at most ``sqrt(2 * rows)`` entries, as the
    weights are row counts); groups of one weight follow a cyclic pattern of folds by position.
    """
    spark = counts.sparkSession
    lean = cut_lineage(counts.select(group, F.col(weight).cast("long").alias(weight)))
    histogram = lean.groupBy(weight).count().orderBy(F.desc(weight)).collect()
    if sum(r["count"] for r in histogram) < k:
        raise ValueError("fewer groups than folds")
    loads = [0] * k
    plan = []
    for r in histogram:
        if r[weight] <= 0:
            # a weightless group never changes the loads: always the first lightest fold
            plan.append((r[weight], [(0, [min(range(k), key=lambda f: (loads[f], f))])]))
        else:
            plan.append((r[weight], _stages(loads, r[weight], r["count"])))
    schema = f"`{weight}` long, stages array<struct<at:long,cycle:array<int>>>"
    table = spark.createDataFrame([(w, [(a, c) for a, c in st]) for w, st in plan], schema)
    placed = ordered_positions(lean, [group], [weight], "__up")
    sizes = placed.groupBy(weight).agg(F.max("__up").alias("__last"))
    placed = placed.join(sizes, weight).withColumn("__pos", F.col("__last") - F.col("__up"))
    joined = placed.join(table, weight)
    stage = F.element_at(F.filter("stages", lambda s: s["at"] <= F.col("__pos")), -1)
    cycle = stage["cycle"]
    step = ((F.col("__pos") - stage["at"]) % F.size(cycle)).cast("int")
    return joined.select(group, weight, (F.get(cycle, step) + 1).alias("fold"))


def time_series_split(df: DataFrame, order: Sequence[str], k: int) -> DataFrame:
    """Test fold 1..k by position (null for the untested head) and the position itself.

    Rows before the first test row of fold ``f`` train it.
    """
    n = df.count()
    size = n // (k + 1)
    if size == 0:
        raise ValueError("too few rows for the number of folds")
    placed = ordered_positions(df, order)
    head = n - k * size
    fold = F.when(F.col("pos") >= head, F.floor((F.col("pos") - head) / size) + 1).cast("int")
    return placed.withColumn("fold", fold)


def manifest_differences(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows on one side only; rows move only where the digests of their bucket differ."""
    return row_differences(manifest, stored.select(*manifest.columns))


def ensure_manifest(manifest: DataFrame, path: str) -> DataFrame:
    """Write the manifest once; later calls must reproduce it exactly."""
    from foldline.sources.tables import _hadoop

    spark: SparkSession = manifest.sparkSession
    fs, target, _ = _hadoop(spark, path)
    if not fs.exists(target):
        manifest.write.mode("errorifexists").parquet(path)
        return spark.read.parquet(path)
    stored = spark.read.parquet(path)
    if set(stored.columns) != set(manifest.columns) or not same_rows(manifest, stored.select(*manifest.columns)):
        raise ValueError(f"fold manifest differs from {path}")
    return stored


def suffix_counts_per_entity(df: DataFrame, value: str, entity: str) -> DataFrame:
    """Rows to be predicted per entity, the weights of a balanced assignment."""
    return df.groupBy(entity).agg(F.sum(F.col(value).isNull().cast("long")).alias("scored_rows"))
