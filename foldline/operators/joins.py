"""Alignment, audited joins, lookups along a coordinate, and upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldline.operators.ranks import group_medians, quantile_scalar
from foldline.operators.series import CHUNK_ROWS, lay_out, ordered_positions, running


def align_to_template(template: DataFrame, preds: DataFrame, id: str) -> DataFrame:
    """Template rows with the predictions of their id."""
    return template.join(preds, id, "left")


def missing_ids(template: DataFrame, preds: DataFrame, id: str) -> DataFrame:
    return template.select(id).join(preds.select(id), id, "left_anti")


def join_oof(a: DataFrame, b: DataFrame, id: str, target: str) -> DataFrame:
    """Inner join of two prediction sets; the second target is kept as ``<target>_other``."""
    return a.join(b.withColumnRenamed(target, f"{target}_other"), id)


def join_oof_audit(a: DataFrame, b: DataFrame, id: str, target: str, atol: float = 1e-8, rtol: float = 1e-5) -> DataFrame:
    """One row: rows and duplicates per side, ids on one side only, targets that disagree."""
    left = a.groupBy(id).agg(F.count("*").alias("na"), F.min(target).alias("ta"))
    right = b.groupBy(id).agg(F.count("*").alias("nb"), F.min(target).alias("tb"))
    both = left.join(right, id, "full_outer")
    apart = F.abs(F.col("ta") - F.col("tb")) > atol + rtol * F.abs("tb")

    def count(c: Column) -> Column:
        return F.sum(F.coalesce(c, F.lit(False)).cast("long"))

    return both.agg(
        F.coalesce(F.sum("na"), F.lit(0)).alias("rows_a"), F.coalesce(F.sum("nb"), F.lit(0)).alias("rows_b"),
        count(F.col("na") > 1).alias("duplicates_a"), count(F.col("nb") > 1).alias("duplicates_b"),
        count(F.col("nb").isNull()).alias("only_a"), count(F.col("na").isNull()).alias("only_b"), count(apart).alias("target_mismatches"),
    )


def join_strict_audit(a: DataFrame, b: DataFrame, key: str, exact: Sequence[str]) -> DataFrame:
    """One row proving a full outer one-to-one join: side counts, presence and unequal fields."""
    left = a.select(key, F.lit(True).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in exact])
    right = b.select(key, F.lit(True).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in exact])
    joined = left.join(right, key, "full_outer")
    both = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    checks = [
        F.sum(F.col("__b").isNull().cast("long")).alias("only_a"), F.sum(F.col("__a").isNull().cast("long")).alias("only_b"),
        (F.count("*") - F.count_distinct(key)).alias("duplicate_keys"),
    ]
    checks += [
        F.sum((both & ~F.col(f"__a_{c}").eqNullSafe(F.col(f"__b_{c}"))).cast("long")).alias(f"unequal_{c}") for c in exact
    ]
    return joined.agg(*checks)


def join_strict(a: DataFrame, b: DataFrame, key: str, exact: Sequence[str]) -> DataFrame:
    """One-to-one join that refuses missing or duplicate keys and unequal shared fields."""
    audit = join_strict_audit(a, b, key, exact).first().asDict()
    broken = {k: v for k, v in audit.items() if v}
    if broken:
        raise ValueError(f"join refused: {broken}")
    return a.join(b.drop(*exact), key)


def audit_alignment(frame: DataFrame, locked: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row: keys without a locked row and null-safe field differences after a left join."""
    right = locked.select(key, F.lit(True).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in fields])
    joined = frame.join(right, key, "left")
    found = F.col("__b").isNotNull()
    return joined.agg(
        F.count("*").alias("rows"), F.sum((~found).cast("long")).alias("missing"),
        *[F.sum((found & ~F.col(c).eqNullSafe(F.col(f"__b_{c}"))).cast("long")).alias(f"unequal_{c}") for c in fields],
    )


def sync_scores(ledger: DataFrame, feed: DataFrame, file: str, feed_file: str, seq: str, score: str = "publicScore", extra: Sequence[str] = ()) -> DataFrame:
    """Ledger rows take score and extra fields of the last feed row of their file, if its score parses; the others stay as they are."""
    last = feed.groupBy(F.col(feed_file).alias(file)).agg(
        F.max_by(F.struct(F.col(score).alias("s"), *[F.col(c) for c in extra]), F.col(seq)).alias("__f")
    )
    parsed = F.col("__f.s").try_cast("double")
    hit = parsed.isNotNull()
    out = ledger.join(last, file, "left").withColumn("lb_score", F.coalesce(parsed, F.col("lb_score")))
    own = {c: F.col(c) if c in ledger.columns else F.lit(None) for c in extra}
    out = out.withColumns({c: F.when(hit, F.col(f"__f.{c}")).otherwise(own[c]) for c in extra} | {"synced": hit})
    return out.drop("__f")


# ---------------------------------------------------------------- lookups along a coordinate


def neighbours(query: DataFrame, curve: DataFrame, entity: str, x: str, value: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Query rows with ``before`` and ``after``: the curve points at or below and above ``x``.

    Curve duplicates are averaged. Points and queries are merged into one ordered series per entity,
    so no query meets every point, and long series are carried across chunks.
    """
    points = curve.filter(F.col(x).isNotNull() & F.col(value).isNotNull()).groupBy(entity, x).agg(F.avg(value).alias("__v"))
    cols = [c for c in query.columns if c not in (entity, x)]
    tagged = query.select(entity, x, F.lit(1).alias("__q"), F.struct(*cols).alias("__row") if cols else F.struct(F.lit(1).alias("one")).alias("__row"))
    pts = points.select(entity, F.col(x).cast("double").alias(x), F.lit(0).alias("__q"), "__v")
    merged = tagged.withColumn(x, F.col(x).cast("double")).unionByName(pts, allowMissingColumns=True)
    point = F.when(F.col("__q") == 0, F.struct(F.col(x).alias("x"), F.col("__v").alias("v")))
    order = [x, "__q"]
    merged, lay, _ = lay_out(merged, order, [entity], chunk_rows)
    seen = running(merged, {"before": ("last", point)}, order, [entity], chunk_rows=lay)
    seen = running(seen, {"after": ("last", point)}, order, [entity], reverse=True, chunk_rows=lay)
    rows = seen.filter(F.col("__q") == 1)
    return rows.select(entity, x, *([F.col(f"__row.{c}").alias(c) for c in cols]), "before", "after")


def interp_join(query: DataFrame, curve: DataFrame, entity: str, x: str, value: str, out: str, clamp: bool = True, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Linear interpolation of each entity's curve; beyond the ends the end value, or null."""
    near = neighbours(query, curve, entity, x, value, chunk_rows)
    b, a, at = F.col("before"), F.col("after"), F.col(x)
    share = (at - b["x"]) / (a["x"] - b["x"])
    inside = b["v"] * (1 - share) + a["v"] * share
    end = F.coalesce(b["v"], a["v"]) if clamp else F.lit(None).cast("double")
    y = (
        F.when(at.isNull(), None)
        .when(b.isNotNull() & (b["x"] == at), b["v"])
        .when(b.isNotNull() & a.isNotNull(), inside)
        .otherwise(end)
    )
    return near.withColumn(out, y).drop("before", "after")


def nearest(query: DataFrame, curve: DataFrame, entity: str, x: str, value: str, out: str = "nearest", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Closest curve point (the lower one on ties), as coordinate and value."""
    near = neighbours(query, curve, entity, x, value, chunk_rows)
    b, a, at = F.col("before"), F.col("after"), F.col(x)
    pick = F.when(a.isNull() | (at - b["x"] <= a["x"] - at), b).otherwise(a)
    return near.withColumn(out, F.coalesce(F.when(b.isNotNull(), pick), a)).drop("before", "after")


def interpolate(df: DataFrame, value: str, coord: str, entity: str, out: str, order: str | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Fill gaps of a series linearly over a coordinate, flat beyond the observed ends.

    A missing coordinate is replaced by the row order when that column is given.
    """
    at = F.coalesce(F.col(coord), F.col(order).cast("double")) if order else F.col(coord)
    rows = df.withColumn("__at", at.cast("double"))
    return interp_join(rows, rows.select(entity, "__at", value), entity, "__at", value, out, chunk_rows=chunk_rows).drop("__at")


def fallback_value(
    template: DataFrame, series: DataFrame, curve: DataFrame, entity: str, value: str, order: Sequence[str], curve_value: str, out: str = "fallback"
) -> DataFrame:
    """Last observed value of the entity, else the median of its curve, else the median of those medians."""
    last = series.filter(F.col(value).isNotNull()).groupBy(entity).agg(
        F.max_by(value, F.struct(*[F.col(c) for c in order])).alias("__last")
    )
    medians = group_medians(curve.filter(F.col(curve_value).isNotNull()), [curve_value], [entity]).withColumnRenamed(curve_value, "__median")
    overall = F.coalesce(quantile_scalar(medians, "__median", 0.5), F.lit(0.0))
    joined = template.join(last, entity, "left").join(medians, entity, "left")
    return joined.withColumn(out, F.coalesce("__last", "__median", overall)).drop("__last", "__median")


def same_order(a: DataFrame, b: DataFrame, id: str, order_a: Sequence[str], order_b: Sequence[str]) -> DataFrame:
    """Rows, and positions at which two ordered id lists differ."""
    left = ordered_positions(a.select(id, *[c for c in order_a if c != id]), order_a).select("pos", F.col(id).alias("__ia"))
    right = ordered_positions(b.select(id, *[c for c in order_b if c != id]), order_b).select("pos", F.col(id).alias("__ib"))
    joined = left.join(right, "pos", "full_outer")
    return joined.agg(F.count("*").alias("rows"), F.sum((~F.col("__ia").eqNullSafe(F.col("__ib"))).cast("long")).alias("mismatches"))


def upsert_latest(ledger: DataFrame, key: str, seq: str) -> DataFrame:
    """Latest row per trimmed, case-folded key."""
    norm = F.lower(F.trim(F.col(key)))
    best = ledger.groupBy(norm.alias("__k")).agg(F.max_by(F.struct(*ledger.columns), F.col(seq)).alias("__r"))
    return best.select("__r.*")


def attach_fold(df: DataFrame, manifest: DataFrame, entity: str, fold: str = "fold") -> DataFrame:
    """Fold of each row's entity; raises when an entity is not in the manifest."""
    unmapped = df.select(entity).join(manifest.select(entity), entity, "left_anti")
    if not unmapped.isEmpty():
        raise ValueError("entities without a fold")
    return df.join(manifest.select(entity, fold), entity)


def same_ids(a: DataFrame, b: DataFrame, id: str) -> DataFrame:
    """Distinct ids on one side only, in both directions."""
    both = a.groupBy(id).agg(F.lit(True).alias("__a")).join(b.groupBy(id).agg(F.lit(True).alias("__b")), id, "full_outer")
    return both.agg(
        F.sum(F.col("__b").isNull().cast("long")).alias("only_a"), F.sum(F.col("__a").isNull().cast("long")).alias("only_b")
    )


def collect_candidates(listings: Sequence[DataFrame], name: str, stamp: str) -> DataFrame:
    """Union of file listings, one row per name (its newest), to be read newest first."""
    out = listings[0]
    for other in listings[1:]:
        out = out.unionByName(other)
    best = out.groupBy(name).agg(F.max_by(F.struct(*[c for c in out.columns if c != name]), F.col(stamp)).alias("__r"))
    return best.select(name, "__r.*")
