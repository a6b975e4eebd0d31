"""Average ranks, exact quantiles and rank-space transforms over whole columns.

Ranks come from one range sort of the rows, quantiles of large groups from radix selection without any.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from foldline.functions.normal import probit
from foldline.operators.moments import scalar_stats
from foldline.operators.quantiles import radix_quantiles
from foldline.operators.series import CHUNK_ROWS, longest_series, null_safe_join, ordered_positions, prefix_counts
from foldline.session import cut_lineage


#: Rows and bytes of a sorted stretch that is ranked at once in a task.
STRETCH_ROWS, STRETCH_BYTES = 1 << 20, 64 << 20


def _changes(column: pa.ChunkedArray) -> np.ndarray:
    """Whether each row but the first differs from the one before; null equals null and not-a-number itself."""
    a, b = column.slice(0, max(0, len(column) - 1)), column.slice(1)
    same = pc.fill_null(pc.equal(a, b), False)
    if pa.types.is_floating(column.type):
        same = pc.or_(same, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
    same = pc.or_(same, pc.and_(pc.is_null(a), pc.is_null(b)))
    return ~same.to_numpy(zero_copy_only=False) if isinstance(same, pa.Array) else ~np.asarray(same)


def _rank_stretch(table: pa.Table, by: list[str], col: str, stretch: int) -> pa.RecordBatch:
    """``table``, sorted by group and value, with ranks inside each segment (the rows of one group) of this stretch.

    The first and the last segment may go on in other stretches: they are named in ``__seg``, and ``__edge`` tells the rows
    that tie with their first (1) or last (2) value, which may go on too. All other ranks are final.
    """
    n, valid = len(table), ~np.asarray(table[col].is_null())
    starts = np.zeros(n, bool)
    starts[0] = True
    for c in by:
        starts[1:] |= _changes(table[c])
    segment = np.cumsum(starts) - 1
    runs = starts.copy()
    runs[1:] |= _changes(table[col])
    run = np.cumsum(runs) - 1
    count = np.cumsum(valid)
    seg_at, run_at = np.flatnonzero(starts), np.flatnonzero(runs)
    before_segment = count[seg_at] - valid[seg_at]
    size = np.append(before_segment[1:], count[-1]) - before_segment
    length = np.diff(np.append(run_at, n))
    at = (count[run_at] - valid[run_at] - before_segment[segment[run_at]])[run]  # valid rows of the segment before the run
    last = segment[-1]
    seg = np.where(segment == last, 2 * stretch + 1, 2 * stretch)
    is_open = (segment == 0) | (segment == last)
    length, size = length[run], size[segment]
    edge = np.where(valid & is_open, (at == 0) * 1 + (at + length == size) * 2, 0)
    rank = at + (length + 1) / 2.0
    extra = {
        "__seg": pa.array(seg, pa.int64(), mask=~is_open), "__edge": pa.array(edge, pa.int8()), "__len": pa.array(length, pa.int64()),
        "__rank": pa.array(rank, pa.float64(), mask=~valid), "__total": pa.array(size, pa.int64()),
    }
    for name, values in extra.items():
        table = table.append_column(name, values)
    return table.combine_chunks()


def _ranked_stretches(df: DataFrame, by: list[str], col: str) -> DataFrame:
    """Rows range-sorted once by group and value, with what :func:`_rank_stretch` says of them.

    A hash of the row is the last sort key, so that one very frequent value is spread over many tasks.
    """
    names, plain = df.columns, [f"c{i}" for i in range(len(df.columns))]
    by, col = [plain[names.index(c)] for c in by], plain[names.index(col)]
    df = df.toDF(*plain)  # mapInArrow takes no names with dots
    hashable = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    keys = [*by, col, "__mix"]
    laid = df.withColumn("__mix", F.xxhash64(*hashable)).repartitionByRange(*keys).sortWithinPartitions(*keys).drop("__mix")
    schema = T.StructType(
        [*df.schema.fields, T.StructField("__seg", T.LongType()), T.StructField("__edge", T.ByteType()), T.StructField("__len", T.LongType()),
         T.StructField("__rank", T.DoubleType()), T.StructField("__total", T.LongType())]
    )

    def run(batches):
        part, held, rows, size, number = TaskContext.get().partitionId(), [], 0, 0, 0

        def ranked():
            yield from _rank_stretch(pa.Table.from_batches(held), by, col, (part << 20) + number).to_batches(max_chunksize=1 << 14)

        for batch in batches:
            held, rows, size = [*held, batch], rows + batch.num_rows, size + batch.nbytes
            if rows >= STRETCH_ROWS or size >= STRETCH_BYTES:
                yield from ranked()
                held, rows, size, number = [], 0, 0, number + 1
        if rows:
            yield from ranked()

    done = laid.mapInArrow(run, schema)
    return cut_lineage(done.toDF(*names, *done.columns[len(names) :]))


def _edges(rows: DataFrame, by: list[str], col: str) -> DataFrame:
    """One row per open segment (at most two a stretch): its rows before it in its group, the group's total, and rank of its
    first and last value over all segments that hold them."""
    own = rows.filter(F.col("__seg").isNotNull()).groupBy("__seg").agg(
        *[F.any_value(c).alias(c) for c in by], F.max("__total").alias("__n"), F.min(col).alias("__lo"), F.max(col).alias("__hi"),
        F.max(F.when(F.col("__edge").isin(1, 3), F.col("__len"))).alias("__lo_n"), F.max(F.when(F.col("__edge").isin(2, 3), F.col("__len"))).alias("__hi_n"),
    )
    earlier = Window.partitionBy(*by).orderBy("__seg").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({"__off": F.coalesce(F.sum("__n").over(earlier), F.lit(0)), "__all": F.sum("__n").over(Window.partitionBy(*by))})
    ends = own.withColumn("__low", F.explode(F.array(F.lit(True), F.lit(False))))
    low, several = F.col("__low"), F.col("__lo_n") < F.col("__n")  # a segment of one value counts once
    ends = ends.withColumns(
        {
            "__v": F.when(low, F.col("__lo")).otherwise(F.col("__hi")),
            "__c": F.when(low, F.col("__lo_n")).when(several, F.col("__hi_n")).otherwise(0),
            "__at": F.when(low, F.col("__off")).when(several, F.col("__off") + F.col("__n") - F.col("__hi_n")),
        }
    )
    tie = Window.partitionBy(*by, "__v")
    ranked = ends.withColumn("__r", F.min("__at").over(tie) + (F.sum("__c").over(tie) + 1) / 2.0)
    return ranked.groupBy(F.col("__seg").alias("__s")).agg(
        F.any_value("__off").alias("__off"), F.any_value("__all").alias("__all"), F.max(F.when(F.col("__low"), F.col("__r"))).alias("__low_r"), F.max(F.when(~F.col("__low"), F.col("__r"))).alias("__high_r"),
    )


def average_rank(df: DataFrame, col: str, by: Sequence[str] = (), out: str = "rank", total: str | None = None) -> DataFrame:
    """Ranks from 1 in each group, ties averaged; null for null. ``total`` also keeps the group's number of values.

    One range sort: running counts inside sorted stretches of rows, then a table with at most two rows a stretch mends the
    ranks of groups and ties that cross from one into the next. Groups that lie inside a stretch are done without it.
    """
    by = list(by)
    rows = _ranked_stretches(df, by, col)
    edges = cut_lineage(_edges(rows, by, col))
    joined = rows.join(edges, F.col("__seg") == F.col("__s"), "left")
    edge = F.col("__edge")
    rank = (
        F.when(F.col("__seg").isNull() | F.col(col).isNull(), F.col("__rank")).when(edge.isin(1, 3), F.col("__low_r")).when(edge == 2, F.col("__high_r"))
        .otherwise(F.col("__rank") + F.col("__off"))
    )
    size = F.when(F.col("__seg").isNull(), F.col("__total")).otherwise(F.col("__all"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns if c not in (out, total)], rank.alias(out), *([size.alias(total)] if total else []))


def rank_normalize(df: DataFrame, col: str, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """``((rank - 0.5) / n) * 2 - 1`` in (-1, 1)."""
    ranked = average_rank(df, col, by, "__r", "__t")
    return ranked.withColumn(out or f"{col}_rank", (F.col("__r") - 0.5) / F.col("__t") * 2 - 1).drop("__r", "__t")


def rank_gauss(df: DataFrame, col: str, by: Sequence[str] = (), out: str | None = None) -> DataFrame:
    """Normal scores of ``(rank - 0.5) / n``."""
    ranked = average_rank(df, col, by, "__r", "__t")
    return ranked.withColumn(out or f"{col}_gauss", probit((F.col("__r") - 0.5) / F.col("__t"))).drop("__r", "__t")


def rank_normalize_many(df: DataFrame, cols: Sequence[str], suffix: str = "_rank") -> DataFrame:
    for c in cols:
        df = rank_normalize(df, c, out=f"{c}{suffix}")
    return df


def ecdf_position(ref: DataFrame, new: DataFrame, col: str, out: str = "below") -> DataFrame:
    """Reference values strictly below each new value, through counts over the merged values."""
    both = (
        ref.select(F.col(col).alias("__v"), F.lit(1).alias("__r"))
        .unionByName(new.select(F.col(col).alias("__v"), F.lit(0).alias("__r")))
        .filter(F.col("__v").isNotNull())
        .groupBy("__v")
        .agg(F.sum("__r").alias("__n"))
    )
    placed = prefix_counts(both, "__n", ["__v"], (), out).select(F.col("__v").alias(col), out)
    return new.join(placed, col, "left")


def ecdf_map(ref: DataFrame, new: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """Normal scores of new values under the reference distribution, clipped 1e-6 from the ends."""
    n = ref.agg(F.count(col)).scalar()
    p = F.least(F.greatest((F.col("__below") + 0.5) / n, F.lit(1e-6)), F.lit(1 - 1e-6))
    return ecdf_position(ref, new, col, "__below").withColumn(out or f"{col}_gauss", probit(p)).drop("__below")


def zscore(df: DataFrame, col: str, ref: DataFrame | None = None, out: str | None = None) -> DataFrame:
    """Standardise by the reference mean and population std (0 counts as 1)."""
    base = ref if ref is not None else df
    s = scalar_stats(base, mu=F.avg(F.col(col).cast("double")), sd=F.stddev_pop(F.col(col).cast("double")))
    sd = F.when(s["sd"] == 0, 1.0).otherwise(s["sd"])
    return df.withColumn(out or f"{col}_z", (F.col(col) - s["mu"]) / sd)


def time_decay_weights(df: DataFrame, decay: float, order: Sequence[str], out: str = "weight", pos: str | None = None) -> DataFrame:
    """``decay ** (1 - pos / (n - 1))`` scaled to a mean of one."""
    placed = df if pos else ordered_positions(df, order, out="__pos")
    at = pos or "__pos"
    n = F.greatest(placed.agg(F.count("*")).scalar() - 1, F.lit(1)).cast("double")
    raw = placed.withColumn(out, F.pow(F.lit(float(decay)), 1 - F.col(at) / n))
    result = raw.withColumn(out, F.col(out) / raw.agg(F.avg(out)).scalar())
    return result if pos else result.drop("__pos")


def exact_quantiles(
    df: DataFrame, col: str, probs: Sequence[float], by: Sequence[str] = (), out: str = "q", task_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Interpolated quantiles per group as an array, exact at any group size.

    The built-in exact percentile keeps every distinct value of a group in one task, so it only serves groups of up to
    ``task_rows`` values. The few larger ones (at most rows / ``task_rows``) are answered together by radix selection.
    """
    by = list(by)
    probs = [float(p) for p in probs]
    lean = df.select(*by, F.col(col).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    agg = F.percentile("__v", F.array(*[F.lit(p) for p in probs])).alias(out)
    spark = df.sparkSession
    if not by:
        if lean.count() <= task_rows:
            return lean.agg(agg)
        return spark.createDataFrame([(radix_quantiles(lean, ["__v"], probs)[0, 0].tolist(),)], f"`{out}` array<double>")
    sizes = lean.groupBy(*by).count()
    large = sizes.filter(F.col("count") > task_rows).drop("count").collect()
    if not large:
        return lean.groupBy(*by).agg(agg)
    schema = T.StructType([lean.schema[c] for c in by])
    numbered = spark.createDataFrame([(*r, i) for i, r in enumerate(large)], T.StructType([*schema.fields, T.StructField("__unit", T.IntegerType())]))
    placed = null_safe_join(lean, numbered, by, "left")
    found = radix_quantiles(placed, ["__v"], probs, "__unit", [[i] for i in range(len(large))])[:, 0]
    big = spark.createDataFrame([(*r, q.tolist()) for r, q in zip(large, found)], T.StructType([*schema.fields, T.StructField(out, T.ArrayType(T.DoubleType()))]))
    return placed.filter("__unit IS NULL").groupBy(*by).agg(agg).unionByName(big)


def quantile_scalar(df: DataFrame, col: str, p: float, task_rows: int = CHUNK_ROWS) -> Column:
    """One exact quantile of a whole column, as a scalar subquery."""
    return exact_quantiles(df, col, [p], task_rows=task_rows).select(F.element_at("q", 1)).scalar()


def group_medians(df: DataFrame, cols: Sequence[str], by: Sequence[str], task_rows: int = CHUNK_ROWS) -> DataFrame:
    """Exact medians of several columns per group."""
    by = list(by)
    if longest_series(df, by) <= task_rows:
        return df.groupBy(*by).agg(*[F.median(F.col(c).cast("double")).alias(c) for c in cols])
    out = df.select(*by).distinct()
    for c in cols:
        m = exact_quantiles(df, c, [0.5], by, task_rows=task_rows).select(*by, F.element_at("q", 1).alias(c))
        out = null_safe_join(out, m, by, "left")
    return out


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average ranks over rows where both values exist."""
    both = df.select(a, b).dropna()
    ranked = average_rank(average_rank(both, a, out="__ra"), b, out="__rb")
    return ranked.agg(F.corr("__ra", "__rb").alias("spearman"))


def tail_overlap(df: DataFrame, id: str, a: str, b: str, pct: float = 0.01) -> DataFrame:
    """Shared ids among the top and bottom ``pct`` of two predictions, as shares of the tail size."""
    n = df.count()
    k = max(1, int(n * pct))
    placed = ordered_positions(ordered_positions(df.select(id, a, b), [a, id], out="__pa"), [b, id], out="__pb")
    top = (F.col("__pa") >= n - k) & (F.col("__pb") >= n - k)
    low = (F.col("__pa") < k) & (F.col("__pb") < k)
    return placed.agg(
        (F.sum(top.cast("long")) / float(k)).alias("top_overlap"), (F.sum(low.cast("long")) / float(k)).alias("bottom_overlap")
    )


def rank_comparison(df: DataFrame, a: str, b: str, quantile: float = 0.9) -> DataFrame:
    """One row on two predictions: Pearson, Spearman, mean and upper-quantile absolute rank delta."""
    ranked = rank_normalize_many(df.select(a, b), [a, b])
    gap = F.abs(F.col(f"{a}_rank") - F.col(f"{b}_rank")) / 2
    ranked = ranked.withColumn("__gap", gap)
    upper = quantile_scalar(ranked, "__gap", quantile)
    return ranked.agg(
        F.corr(a, b).alias("pearson"), F.corr(f"{a}_rank", f"{b}_rank").alias("spearman"), F.avg("__gap").alias("mean_rank_delta")
    ).withColumn("upper_rank_delta", upper)


def submission_delta(df: DataFrame, id: str, a: str, b: str, pct: float = 0.01) -> DataFrame:
    """Rank comparison together with the tail overlaps."""
    tails = tail_overlap(df, id, a, b, pct)
    return rank_comparison(df, a, b).withColumns(
        {c: tails.select(c).scalar() for c in ("top_overlap", "bottom_overlap")}
    )
