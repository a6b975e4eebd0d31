"""Window features over ordered series; ``part`` may be empty for one global series."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from foldline.operators.series import CHUNK_ROWS, bounded_frames, ema, lay_out, running, tidy

LAGS = (1, 2, 3, 5, 10)
WINDOWS = (5, 10, 20, 50)


def _frame(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), 0)


def full(agg, c: Column, n: int, w: WindowSpec) -> Column:
    """An aggregate over the last ``n`` rows; null unless all of them hold a value."""
    f = _frame(w, n)
    return F.when(F.count(c).over(f) >= n, agg(c).over(f))


def lag_features(df, cols, lags: Sequence[int] = LAGS, order=(), part=(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    def level(w):
        return {f"{c}_lag_{k}": F.lag(c, k).over(w) for c in cols for k in lags}

    return bounded_frames(df, [level], order, part, before=max(lags), chunk_rows=chunk_rows)


def rolling_stats(df, cols, windows: Sequence[int] = WINDOWS, order=(), part=(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Mean, sample std, min and max over the last rows that exist (at least one value)."""
    fns = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}

    def level(w):
        return {
            f"{c}_roll_{k}_{n}": fn(F.col(c)).over(_frame(w, n)) for c in cols for n in windows for k, fn in fns.items()
        }

    return bounded_frames(df, [level], order, part, before=max(windows) - 1, chunk_rows=chunk_rows)


def rsi(df, col, n: int = 14, order=(), part=(), out: str | None = None, chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Relative strength: rolling mean gain over rolling mean loss; a missing difference counts as 0."""
    out = out or f"{col}_rsi_{n}"

    def moves(w):
        d = F.col(col) - F.lag(col, 1).over(w)
        return {
            "__gain": F.when(d > 0, d).otherwise(F.lit(0.0)),
            "__loss": F.when(d < 0, -d).otherwise(F.lit(0.0)),
        }

    def ratio(w):
        rs = F.try_divide(full(F.avg, F.col("__gain"), n, w), full(F.avg, F.col("__loss"), n, w))
        return {out: 100 - 100 / (1 + rs)}

    return bounded_frames(df, [moves, ratio], order, part, before=n, chunk_rows=chunk_rows).drop("__gain", "__loss")


def macd(df, col, fast: int = 12, slow: int = 26, signal: int = 9, order=(), part=(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    df, lay, own = lay_out(df, order, part, chunk_rows)
    df = ema(df, {"__fast": (F.col(col), fast), "__slow": (F.col(col), slow)}, order, part, lay)
    df = df.withColumn(f"{col}_macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
    return tidy(ema(df, {f"{col}_macd_signal": (F.col(f"{col}_macd"), signal)}, order, part, lay), own)


def _bollinger(col: str, n: int, k: float):
    def level(w):
        x = F.col(col)
        mid, sd = full(F.avg, x, n, w), full(F.stddev_samp, x, n, w)
        return {
            f"{col}_bb_upper": mid + k * sd,
            f"{col}_bb_lower": mid - k * sd,
            f"{col}_bb_width": F.try_divide(2 * k * sd, mid),
        }

    return level


def bollinger(df, col, n: int = 20, k: float = 2.0, order=(), part=(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    return bounded_frames(df, [_bollinger(col, n, k)], order, part, before=n - 1, chunk_rows=chunk_rows)


def moving_averages(df, col, periods: Sequence[int] = (5, 10, 20, 50), order=(), part=(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    def level(w):
        return {f"{col}_sma_{n}": full(F.avg, F.col(col), n, w) for n in periods}

    df, lay, own = lay_out(df, order, part, chunk_rows)
    df = bounded_frames(df, [level], order, part, before=max(periods) - 1, chunk_rows=lay)
    return tidy(ema(df, {f"{col}_ema_{n}": (F.col(col), n) for n in periods}, order, part, lay), own)


def padded(df, col, out: str, order=(), part=(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Nulls take the last earlier value."""
    return running(df, {out: ("last", F.col(col))}, order, part, chunk_rows=chunk_rows)


def pct_change(df, col, steps: Sequence[int] = (1, 5), order=(), part=(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Relative change over ``k`` rows after forward padding; a zero base gives null."""
    df, lay, own = lay_out(df, order, part, chunk_rows)
    df = padded(df, col, "__pad", order, part, lay)

    def level(w):
        return {f"{col}_return_{k}": F.try_divide(F.col("__pad"), F.lag("__pad", k).over(w)) - 1 for k in steps}

    return tidy(bounded_frames(df, [level], order, part, before=max(steps), chunk_rows=lay).drop("__pad"), own)


def return_volatility(df, col, windows: Sequence[int] = (10, 20), order=(), part=(), names: str = "volatility", scale: float = 1.0,
                      chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Rolling sample std of one-row returns."""
    df, lay, own = lay_out(df, order, part, chunk_rows)
    df = padded(df, col, "__pad", order, part, lay)

    def returns(w):
        return {"__ret": F.try_divide(F.col("__pad"), F.lag("__pad", 1).over(w)) - 1}

    def stds(w):
        return {f"{names}_{n}": full(F.stddev_samp, F.col("__ret"), n, w) * scale for n in windows}

    done = bounded_frames(df, [returns, stds], order, part, before=max(windows), chunk_rows=lay)
    return tidy(done.drop("__pad", "__ret"), own)


def technical_indicators(df, col, order=(), part=(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    """RSI, MACD, Bollinger bands, moving averages, returns and their volatility of one column.

    All bounded frames share one window sort; only the exponential means need their own pass.
    """
    df, lay, own = lay_out(df, order, part, chunk_rows)
    df = padded(df, col, "__pad", order, part, lay)
    periods = (5, 10, 20, 50)

    def moves(w):
        d = F.col(col) - F.lag(col, 1).over(w)
        step = lambda k: F.try_divide(F.col("__pad"), F.lag("__pad", k).over(w)) - 1
        return {
            "__gain": F.when(d > 0, d).otherwise(F.lit(0.0)),
            "__loss": F.when(d < 0, -d).otherwise(F.lit(0.0)),
            f"{col}_return_1": step(1),
            f"{col}_return_5": step(5),
        }

    def frames(w):
        rs = F.try_divide(full(F.avg, F.col("__gain"), 14, w), full(F.avg, F.col("__loss"), 14, w))
        out = {f"{col}_rsi_14": 100 - 100 / (1 + rs)}
        out |= _bollinger(col, 20, 2.0)(w)
        out |= {f"{col}_sma_{n}": full(F.avg, F.col(col), n, w) for n in periods}
        out |= {f"{col}_volatility_{n}": full(F.stddev_samp, F.col(f"{col}_return_1"), n, w) for n in (10, 20)}
        return out

    df = bounded_frames(df, [moves, frames], order, part, before=49, chunk_rows=lay)
    df = df.drop("__pad", "__gain", "__loss")
    x = F.col(col)
    spans = {f"{col}_ema_{n}": (x, n) for n in periods} | {"__fast": (x, 12), "__slow": (x, 26)}
    df = ema(df, spans, order, part, lay)
    df = df.withColumn(f"{col}_macd", F.col("__fast") - F.col("__slow")).drop("__fast", "__slow")
    return tidy(ema(df, {f"{col}_macd_signal": (F.col(f"{col}_macd"), 9)}, order, part, lay), own)


def true_range_atr(df, high, low, n: int = 14, order=(), part=(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    df = df.withColumn("true_range", F.col(high) - F.col(low))

    def level(w):
        return {f"atr_{n}": full(F.avg, F.col("true_range"), n, w)}

    return bounded_frames(df, [level], order, part, before=n - 1, chunk_rows=chunk_rows)


def realized_vol(df, close, windows: Sequence[int] = (5, 20), annual: float = 252, of: int = 20, order=(), part=(),
                 chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Annualised std of returns, and the rolling std of the ``of``-row one."""
    df, lay, own = lay_out(df, order, part, chunk_rows)
    df = padded(df, close, "__pad", order, part, lay)
    scale = math.sqrt(annual)

    def returns(w):
        return {"__ret": F.try_divide(F.col("__pad"), F.lag("__pad", 1).over(w)) - 1}

    def vols(w):
        return {f"realized_vol_{n}": full(F.stddev_samp, F.col("__ret"), n, w) * scale for n in windows}

    def vol_of_vol(w):
        return {"vol_of_vol": full(F.stddev_samp, F.col(f"realized_vol_{of}"), of, w)}

    done = bounded_frames(df, [returns, vols, vol_of_vol], order, part, before=max(windows) + of, chunk_rows=lay)
    return tidy(done.drop("__pad", "__ret"), own)


def volume_ratio(df, volume, n: int = 10, order=(), part=(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    def level(w):
        sma = full(F.avg, F.col(volume), n, w)
        return {f"volume_sma_{n}": sma, "volume_ratio": F.try_divide(F.col(volume), sma)}

    return bounded_frames(df, [level], order, part, before=n - 1, chunk_rows=chunk_rows)


def volatility(df, high=None, low=None, close=None, volume=None, order=(), part=(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    df, lay, own = lay_out(df, order, part, chunk_rows)
    if high and low:
        df = true_range_atr(df, high, low, 14, order, part, lay)
    if close:
        df = realized_vol(df, close, (5, 20), 252, 20, order, part, lay)
    if volume:
        df = volume_ratio(df, volume, 10, order, part, lay)
    return tidy(df, own)


# ---------------------------------------------------------------- gaps, anchors and progress of entities


def gap_features(df, value, coord, order, part, chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Previous and next observed coordinate and value, distances, span and position in the gap."""
    seen = F.when(F.col(value).isNotNull(), F.struct(F.col(coord).alias("c"), F.col(value).alias("v")))
    df, lay, own = lay_out(df, order, part, chunk_rows)
    df = running(df, {"__prev": ("last", seen)}, order, part, chunk_rows=lay)
    df = tidy(running(df, {"__next": ("last", seen)}, order, part, reverse=True, chunk_rows=lay), own)
    df = df.withColumns(
        {
            "prev_coord": F.col("__prev.c"), "prev_value": F.col("__prev.v"),
            "next_coord": F.col("__next.c"), "next_value": F.col("__next.v"),
        }
    ).drop("__prev", "__next")
    span = F.col("next_coord") - F.col("prev_coord")
    return df.withColumns(
        {
            "since_prev": F.col(coord) - F.col("prev_coord"),
            "until_next": F.col("next_coord") - F.col(coord),
            "gap_span": span,
            "gap_fraction": F.try_divide(F.col(coord) - F.col("prev_coord"), span),
        }
    )


def rate_of_change(df, cols, coord, order, part, chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Change per unit of coordinate since the previous row; a zero step gives null."""

    def level(w):
        step = F.col(coord) - F.lag(coord, 1).over(w)
        return {f"{c}_rate": F.try_divide(F.col(c) - F.lag(c, 1).over(w), step) for c in cols}

    return bounded_frames(df, [level], order, part, before=1, chunk_rows=chunk_rows)


def centered_rolling(df, col, widths: Sequence[int] = (5, 21), order=(), part=(), chunk_rows=CHUNK_ROWS) -> DataFrame:
    """Mean and sample std over a centred frame of ``width`` rows."""

    def level(w):
        out = {}
        for n in widths:
            f = w.rowsBetween(-(n // 2), n // 2)
            out |= {f"{col}_cmean_{n}": F.avg(col).over(f), f"{col}_cstd_{n}": F.stddev_samp(col).over(f)}
        return out

    r = max(widths) // 2
    return bounded_frames(df, [level], order, part, before=r, after=r, chunk_rows=chunk_rows)


def anchor_features(df, value, cols: Sequence[str], entity, order) -> DataFrame:
    """Values at the last observed row and offsets from them, with prefix and suffix summaries.

    One combined aggregate per entity, joined back.
    """
    key = F.struct(*[F.col(c) for c in order])
    seen = F.col(value).isNotNull()
    aggs = [F.max_by(c, F.when(seen, key)).alias(f"anchor_{c}") for c in [value, *cols]]
    aggs += [
        F.count(F.when(seen, 1)).alias("prefix_rows"),
        F.count(F.when(~seen, 1)).alias("suffix_rows"),
        F.avg(value).alias("prefix_mean"),
        F.stddev_samp(value).alias("prefix_std"),
    ]
    for c in cols:
        aggs += [F.avg(F.when(~seen, F.col(c))).alias(f"suffix_{c}_mean"), F.stddev_samp(F.when(~seen, F.col(c))).alias(f"suffix_{c}_std")]
    out = df.join(df.groupBy(entity).agg(*aggs), entity, "left")
    return out.withColumns({f"{c}_since_anchor": F.col(c) - F.col(f"anchor_{c}") for c in cols})


def curve_features(df, curve, entity, value) -> DataFrame:
    """Minimum, maximum, range, mean and std of each entity's reference curve."""
    s = curve.groupBy(entity).agg(
        F.min(value).alias("curve_min"), F.max(value).alias("curve_max"), F.avg(value).alias("curve_mean"),
        F.stddev_samp(value).alias("curve_std"),
    ).withColumn("curve_range", F.col("curve_max") - F.col("curve_min"))
    return df.join(s, entity, "left")


def progress(df, entity, pos, taper: float | None = None) -> DataFrame:
    """Position scaled to [0, 1] per entity, and the taper ``max(0, 1 - taper * progress)``."""
    ends = df.groupBy(entity).agg(F.min(pos).alias("__lo"), F.max(pos).alias("__hi"))
    q = F.try_divide((F.col(pos) - F.col("__lo")).cast("double"), (F.col("__hi") - F.col("__lo")).cast("double"))
    out = df.join(ends, entity).withColumn("progress", F.coalesce(q, F.lit(0.0))).drop("__lo", "__hi")
    if taper is not None:
        out = out.withColumn("taper", F.greatest(F.lit(0.0), 1 - taper * F.col("progress")))
    return out


def tapered_stream(df, base, near, out: str = "tapered") -> DataFrame:
    """``base`` moved toward ``near`` by the taper."""
    return df.withColumn(out, F.col(base) + F.col("taper") * (F.col(near) - F.col(base)))


def progress_audit(df, entity) -> DataFrame:
    """Entities of more than one row whose progress does not run exactly from 0 to 1."""
    ends = df.groupBy(entity).agg(F.min("progress").alias("lo"), F.max("progress").alias("hi"), F.count("*").alias("rows"))
    return ends.filter((F.col("rows") > 1) & ((F.col("lo") != 0) | (F.col("hi") != 1)))
