"""Order-dependent primitives that never put a whole series into one task.

A series is the rows that share ``part`` (possibly no columns at all: one global series), ordered
by a *total* order key. Small series use an ordinary window. A series longer than ``chunk_rows`` is
cut into chunks by position: bounded frames get a halo of neighbouring rows, running aggregates get
a carry from a table with one row per chunk.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from foldline.session import cut_lineage

CHUNK_ROWS = 2_000_000
Level = Callable[[WindowSpec], dict[str, Column]]


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys match null keys; the right keys are dropped."""
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def longest_series(df: DataFrame, part: Sequence[str]) -> int:
    """Rows of the largest group; one map-side combined pass over the key columns only."""
    row = df.groupBy(*part).count().agg(F.max("count")).first()
    return int(row[0] or 0)


def _ranged(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Globally sorted copy of ``df`` with a frozen partition number and row number in it."""
    laid = (
        df.repartitionByRange(*[F.col(k) for k in keys])
        .sortWithinPartitions(*keys)
        .withColumn("__mid", F.monotonically_increasing_id())
    )
    frozen = cut_lineage(laid)
    return frozen.withColumns(
        {
            "__pid": F.shiftright("__mid", 33),
            "__loc": F.col("__mid").bitwiseAND(F.lit((1 << 33) - 1)),
        }
    ).drop("__mid")


def ordered_positions(
    df: DataFrame, order: Sequence[str], part: Sequence[str] = (), out: str = "pos"
) -> DataFrame:
    """0-based position of every row in its series, by a range sort and per-partition offsets.

    Only the offset table (at most one row per range partition and series in it) is windowed.
    """
    part = list(part)
    rows = _ranged(df, [*part, *order])
    blocks = rows.groupBy(*part, "__pid").agg(F.count("*").alias("__n"), F.min("__loc").alias("__first"))
    before = Window.partitionBy(*part).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(
        *part, "__pid", "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off")
    )
    placed = null_safe_join(rows, offsets, [*part, "__pid"])
    return placed.withColumn(out, F.col("__loc") - F.col("__first") + F.col("__off")).drop(
        "__pid", "__loc", "__first", "__off"
    )


def prefix_counts(df: DataFrame, count: str, order: Sequence[str], part: Sequence[str] = (), out: str = "before") -> DataFrame:
    """Exclusive running total of an integer column along the series order."""
    part = list(part)
    rows = _ranged(df, [*part, *order])
    inside = Window.partitionBy(*part, "__pid").orderBy("__loc").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum(count).over(inside), F.lit(0)))
    blocks = rows.groupBy(*part, "__pid").agg(F.sum(count).alias("__n"))
    before = Window.partitionBy(*part).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*part, "__pid", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    placed = null_safe_join(rows, offsets, [*part, "__pid"])
    return placed.withColumn(out, F.col("__in") + F.col("__off")).drop("__pid", "__loc", "__in", "__off")


def fits_one_task(df: DataFrame, part: Sequence[str], chunk_rows: int) -> bool:
    """Whether every series is short enough for a plain window."""
    return bool(part) and longest_series(df, part) <= chunk_rows


POS = "__series_pos"


@dataclass(frozen=True)
class Layout:
    """How the series of a table are cut: plain windows if ``small``, else chunks of a position column."""

    small: bool
    chunk_rows: int


def lay_out(df: DataFrame, order: Sequence[str], part: Sequence[str], chunk_rows: int | Layout) -> tuple[DataFrame, Layout, bool]:
    """Decide the layout once and number the rows if they must be chunked.

    Operators accept a ready :class:`Layout` in place of ``chunk_rows``, so a chain of window features
    checks sizes and sorts the table a single time. The last value tells whether it was made here.
    """
    if isinstance(chunk_rows, Layout):
        return df, chunk_rows, False
    if fits_one_task(df, part, chunk_rows):
        return df, Layout(True, chunk_rows), True
    return ordered_positions(df, order, part, POS), Layout(False, chunk_rows), True


def tidy(df: DataFrame, made_here: bool) -> DataFrame:
    """Drop the position column in the function that added it."""
    return df.drop(POS) if made_here else df


def positions(
    df: DataFrame, order: Sequence[str], part: Sequence[str] = (), out: str = "pos", chunk_rows: int | Layout = CHUNK_ROWS
) -> DataFrame:
    """Positions through a plain window where every series is short, else :func:`ordered_positions`."""
    df, lay, own = lay_out(df, order, part, chunk_rows)
    if lay.small:
        w = Window.partitionBy(*part).orderBy(*order)
        return df.withColumn(out, F.row_number().over(w).cast("long") - 1)
    return tidy(df.withColumn(out, F.col(POS)), own)


def bounded_frames(
    df: DataFrame,
    levels: Sequence[Level],
    order: Sequence[str],
    part: Sequence[str] = (),
    before: int = 0,
    after: int = 0,
    chunk_rows: int | Layout = CHUNK_ROWS,
) -> DataFrame:
    """Apply window expressions whose frames reach at most ``before`` / ``after`` rows away.

    ``levels`` are applied one after the other, so later ones may window over earlier results;
    ``before`` and ``after`` are the reach of all levels together.
    """
    part = list(part)
    df, lay, own = lay_out(df, order, part, chunk_rows)
    if lay.small:
        w = Window.partitionBy(*part).orderBy(*order)
        for level in levels:
            df = df.withColumns(level(w))
        return df
    size = max(lay.chunk_rows, before + after + 1)
    home = F.floor(F.col(POS) / size)
    slot = F.col(POS) % size
    targets = F.array_compact(
        F.array(
            home,
            F.when(slot >= size - before, home + 1) if before else F.lit(None).cast("long"),
            F.when((slot < after) & (home > 0), home - 1) if after else F.lit(None).cast("long"),
        )
    )
    spread = df.withColumn("__home", home).withColumn("__chunk", F.explode(targets))
    w = Window.partitionBy(*part, "__chunk").orderBy(POS)
    for level in levels:
        spread = spread.withColumns(level(w))
    return tidy(spread.filter("__home = __chunk").drop("__home", "__chunk"), own)


_COMBINE = {
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "sum": (F.sum, lambda a, b: F.coalesce(a + b, a, b)),
    "last": (lambda c: F.last(c, ignorenulls=True), lambda local, carry: F.coalesce(local, carry)),
}


def running(
    df: DataFrame,
    specs: dict[str, tuple[str, Column]],
    order: Sequence[str],
    part: Sequence[str] = (),
    reverse: bool = False,
    exclusive: bool = False,
    chunk_rows: int | Layout = CHUNK_ROWS,
) -> DataFrame:
    """Running ``max`` / ``min`` / ``sum`` / ``last`` (non-null) along the series.

    ``specs`` maps an output column to ``(function, expression)``. ``reverse`` runs from the end of
    the series (``last`` is then the next non-null value); ``exclusive`` leaves out the current row.
    """
    part = list(part)
    edge = -1 if exclusive else 0
    df, lay, own = lay_out(df, order, part, chunk_rows)
    if lay.small:
        key = [F.col(c).desc() for c in order] if reverse else [F.col(c) for c in order]
        w = Window.partitionBy(*part).orderBy(*key).rowsBetween(Window.unboundedPreceding, edge)
        return df.withColumns({out: _COMBINE[fn][0](c).over(w) for out, (fn, c) in specs.items()})
    placed = df.withColumn("__chunk", F.floor(F.col(POS) / lay.chunk_rows))
    along = F.col(POS).desc() if reverse else F.col(POS)
    w = Window.partitionBy(*part, "__chunk").orderBy(along).rowsBetween(Window.unboundedPreceding, edge)
    local = placed.withColumns({f"__l_{out}": _COMBINE[fn][0](c).over(w) for out, (fn, c) in specs.items()})

    def of_chunk(fn: str, c: Column) -> Column:
        if fn != "last":
            return _COMBINE[fn][0](c)
        present = F.when(c.isNotNull(), F.col(POS))
        return F.min_by(c, present) if reverse else F.max_by(c, present)

    chunks = placed.groupBy(*part, "__chunk").agg(*[of_chunk(fn, c).alias(f"__c_{o}") for o, (fn, c) in specs.items()])
    across = F.col("__chunk").desc() if reverse else F.col("__chunk")
    wc = Window.partitionBy(*part).orderBy(across).rowsBetween(Window.unboundedPreceding, -1)
    carry = chunks.select(
        *part,
        "__chunk",
        *[_COMBINE[fn][0](F.col(f"__c_{o}")).over(wc).alias(f"__k_{o}") for o, (fn, _) in specs.items()],
    )
    joined = null_safe_join(local, carry, [*part, "__chunk"])
    done = joined.withColumns(
        {o: _COMBINE[fn][1](F.col(f"__l_{o}"), F.col(f"__k_{o}")) for o, (fn, _) in specs.items()}
    )
    extra = [f"__{tag}_{o}" for o in specs for tag in ("l", "k")]
    return tidy(done.drop("__chunk", *extra), own)


EMA_BLOCK = 256


def ema(
    df: DataFrame,
    specs: dict[str, tuple[Column, int]],
    order: Sequence[str],
    part: Sequence[str] = (),
    chunk_rows: int | Layout = CHUNK_ROWS,
) -> DataFrame:
    """Exponential means ``sum(b^k x) / sum(b^k)``, ``b = 1 - 2/(span+1)``, nulls decay but add nothing.

    ``specs`` maps an output column to ``(expression, span)``. Blocks of 256 rows use a closed-form
    running sum; earlier blocks enter through as many block totals as still matter in a double.
    """
    part = list(part)
    df = positions(df, order, part, "__pos", chunk_rows)
    df = df.withColumn("__blk", F.floor(F.col("__pos") / EMA_BLOCK)).withColumn("__i", F.col("__pos") % EMA_BLOCK)
    w = Window.partitionBy(*part, "__blk").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    blocks_aggs, locals_, reach, base = [], {}, {}, {}
    for out, (x, span) in specs.items():
        b = 1.0 - 2.0 / (span + 1.0)
        base[out] = b
        reach[out] = max(1, math.ceil(39.2 / (-math.log(b) * EMA_BLOCK)) + 1)
        grow = F.pow(F.lit(b), -F.col("__i").cast("double"))
        shrink = F.pow(F.lit(b), F.col("__i").cast("double"))
        v = x.cast("double")
        for tag, term in (("s", v * grow), ("n", F.when(v.isNotNull(), grow))):
            locals_[f"__{tag}_{out}"] = F.coalesce(F.sum(term).over(w), F.lit(0.0)) * shrink
            end = F.coalesce(F.sum(term), F.lit(0.0)) * b ** (EMA_BLOCK - 1)
            blocks_aggs.append(end.alias(f"__b{tag}_{out}"))
    totals = df.groupBy(*part, "__blk").agg(*blocks_aggs)
    hops = max(reach.values())
    spread = totals.withColumn("__hop", F.explode(F.sequence(F.lit(1), F.lit(hops)))).withColumn(
        "__blk", F.col("__blk") + F.col("__hop")
    )
    sums = []
    for out in specs:
        fade = F.pow(F.lit(base[out]), (F.col("__hop") - 1) * F.lit(float(EMA_BLOCK)))
        live = F.col("__hop") <= reach[out]
        for tag in "sn":
            sums.append(F.sum(F.when(live, F.col(f"__b{tag}_{out}") * fade)).alias(f"__c{tag}_{out}"))
    carry = spread.groupBy(*part, "__blk").agg(*sums)
    rows = null_safe_join(df.withColumns(locals_), carry, [*part, "__blk"], "left")
    result = {}
    for out in specs:
        step = F.pow(F.lit(base[out]), F.col("__i").cast("double") + 1)
        num = F.col(f"__s_{out}") + step * F.coalesce(F.col(f"__cs_{out}"), F.lit(0.0))
        den = F.col(f"__n_{out}") + step * F.coalesce(F.col(f"__cn_{out}"), F.lit(0.0))
        result[out] = F.when(den > 0, num / den)
    extra = [f"__{t}_{o}" for o in specs for t in ("s", "n", "cs", "cn")]
    return rows.withColumns(result).drop("__pos", "__blk", "__i", *extra)
