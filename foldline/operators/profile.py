"""Dataset profiling: columns, target, leakage, drift, correlations, chart data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foldline.operators.moments import pair_correlation, pair_moments, scalar_stats
from foldline.operators.ranks import exact_quantiles
from foldline.roles import columns_of_kind, kind, numeric_cols

BATCH = 100


def _long(df: DataFrame, per_column: dict[str, dict[str, Column]]) -> DataFrame:
    """Aggregate many columns in one job per batch and return one row per column."""
    names = list(per_column)
    parts = []
    for i in range(0, len(names), BATCH):
        structs = [
            F.struct(F.lit(c).alias("column"), *[e.alias(k) for k, e in per_column[c].items()])
            for c in names[i : i + BATCH]
        ]
        parts.append(df.agg(F.array(*structs).alias("r")).select(F.inline("r")))
    return reduce(DataFrame.unionByName, parts)


def sample_skew(c: Column) -> Column:
    """Bias-corrected skewness; null below three values or without spread."""
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


def value_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(column, value, count)`` of the non-null values; one pruned scan per column, combined map-side."""
    parts = [
        df.filter(F.col(c).isNotNull())
        .groupBy(F.col(c).cast("string").alias("value"))
        .agg(F.count("*").alias("count"))
        .select(F.lit(c).alias("column"), "value", "count")
        for c in cols
    ]
    return reduce(DataFrame.unionByName, parts)


def distinct_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Exact non-null distinct values per column without an Expand over all columns."""
    parts = [
        df.select(c).filter(F.col(c).isNotNull()).groupBy(c).agg(F.lit(1).alias("one"))
        .agg(F.count("*").alias("n_unique")).select(F.lit(c).alias("column"), "n_unique")
        for c in cols
    ]
    return reduce(DataFrame.unionByName, parts)


def profile_columns(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """One row per column: kind, nulls, distinct values, mean, std, min, max, skew."""
    cols = list(cols or df.columns)
    kinds = {f.name: kind(f.dataType) for f in df.schema.fields}
    wanted = {}
    null = F.lit(None).cast("double")
    for c in cols:
        x = F.col(c)
        num = x.cast("double") if kinds[c] == "numeric" else None
        stats = {
            "kind": F.lit(kinds[c]),
            "n_rows": F.count("*"),
            "nulls": F.count("*") - F.count(x),
            "mean": F.avg(num) if num is not None else null,
            "std": F.stddev_samp(num) if num is not None else null,
            "min": F.min(num) if num is not None else null,
            "max": F.max(num) if num is not None else null,
            "skew": sample_skew(num) if num is not None else null,
        }
        if approx:
            stats["n_unique"] = F.approx_count_distinct(x)
        wanted[c] = stats
    out = _long(df, wanted)
    if not approx:
        out = out.join(F.broadcast(distinct_counts(df, cols)), "column")
    return out.withColumns(
        {
            "null_pct": F.try_divide(F.col("nulls").cast("double"), F.col("n_rows").cast("double")),
            "cardinality_pct": F.try_divide(F.col("n_unique").cast("double"), F.col("n_rows").cast("double")),
        }
    )


def top_values(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Most frequent values of each column, ties by value; a distributed top-k per column."""
    tops = [value_counts(df, [c]).orderBy(F.desc("count"), F.asc("value")).limit(k) for c in cols]
    w = Window.partitionBy("column").orderBy(F.desc("count"), F.asc("value"))
    return reduce(DataFrame.unionByName, tops).withColumn("rank", F.row_number().over(w))


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each identical group."""
    return df.groupBy(*df.columns).count().agg(F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"))


def profile_table(
    df: DataFrame, null_threshold: float = 0.3, cardinality_threshold: float = 0.95, approx: bool = False
) -> DataFrame:
    """One row: sizes, kinds and the sorted names of suspicious columns."""
    cols = profile_columns(df, approx=approx)

    def names(cond: Column) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("column")))), ",")

    def number(k: str) -> Column:
        return F.sum(F.when(F.col("kind") == k, 1).otherwise(0))

    out = cols.agg(
        F.max("n_rows").alias("n_rows"),
        F.count("*").alias("n_cols"),
        number("numeric").alias("n_numeric"),
        number("datetime").alias("n_datetime"),
        number("categorical").alias("n_categorical"),
        names(F.col("null_pct") > null_threshold).alias("high_null"),
        names(F.col("cardinality_pct") > cardinality_threshold).alias("high_cardinality"),
        names(F.col("n_unique") <= 1).alias("constant"),
    )
    return out.withColumn("duplicate_rows", duplicate_rows(df).scalar())


def table_bytes(df: DataFrame) -> int:
    """Stored bytes of the files behind ``df`` (stands in for an in-memory size)."""
    from foldline.sources.tables import _hadoop

    total = 0
    for path in df.inputFiles():
        fs, target, _ = _hadoop(df.sparkSession, path)
        total += fs.getFileStatus(target).getLen()
    return total


def target_stats(df: DataFrame, y: str, max_classes: int = 20) -> DataFrame:
    """Long ``(stat, value)``: class counts and imbalance, or moments of a regression target."""
    numeric = kind(df.schema[y].dataType) == "numeric"
    counts = value_counts(df, [y])
    classes = counts.agg(F.count("*")).first()[0]
    if numeric and classes > max_classes:
        x = F.col(y).cast("double")
        return _long(
            df, {y: {"mean": F.avg(x), "std": F.stddev_samp(x), "min": F.min(x), "max": F.max(x)}}
        ).unpivot("column", ["mean", "std", "min", "max"], "stat", "value").select("stat", "value")
    balance = counts.select(F.concat(F.lit("class:"), "value").alias("stat"), F.col("count").cast("double").alias("value"))
    overall = counts.agg(
        F.count("*").cast("double").alias("n_classes"), (F.max("count") / F.min("count")).alias("imbalance_ratio")
    ).unpivot([], ["n_classes", "imbalance_ratio"], "stat", "value")
    return balance.unionByName(overall)


def corr_to_target(df: DataFrame, y: str, cols: Sequence[str] | None = None) -> DataFrame:
    """Pairwise-complete Pearson of every column with the target, in one pass per batch of columns."""
    cols = [c for c in (cols or columns_of_kind(df, "numeric")) if c != y]
    target = F.col(y).cast("double")

    def pearson(c: str) -> Column:
        x = F.col(c).cast("double")
        both = x.isNotNull() & target.isNotNull()
        spread = (F.stddev_pop(F.when(both, x)) > 0) & (F.stddev_pop(F.when(both, target)) > 0)
        return F.when(spread, F.corr(x, target))

    return _long(df, {c: {"corr": pearson(c)} for c in cols})


def leakage(df: DataFrame, y: str, threshold: float = 0.95) -> DataFrame:
    """Numeric columns whose absolute correlation with the target exceeds the threshold."""
    if kind(df.schema[y].dataType) != "numeric":
        return corr_to_target(df, df.columns[0], [c for c in numeric_cols(df)][:1]).limit(0)
    return corr_to_target(df, y).filter(F.abs("corr") > threshold)


def distribution_shift(train: DataFrame, test: DataFrame, threshold: float = 1.0) -> DataFrame:
    """Columns whose mean moved by more than ``threshold`` training standard deviations."""
    cols = [c for c in columns_of_kind(train, "numeric") if c in test.columns]
    a = _long(train, {c: {"train_mean": F.avg(F.col(c).cast("double")), "sd": F.stddev_samp(F.col(c).cast("double"))} for c in cols})
    b = _long(test, {c: {"test_mean": F.avg(F.col(c).cast("double"))} for c in cols})
    score = F.abs(F.col("train_mean") - F.col("test_mean")) / F.nullif(F.col("sd"), F.lit(0.0))
    return (
        a.join(F.broadcast(b), "column")
        .withColumn("shift_score", score)
        .filter(F.col("shift_score") > threshold)
        .select("column", "train_mean", "test_mean", "shift_score")
    )


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long ``(a, b, corr)`` for a before b, over rows in which both are present.

    One scan that evaluates each column once, with or without nulls; pairs are formed on the aggregated statistics, never on rows.
    """
    cols = list(cols)
    named = [f"c{i}" for i in range(len(cols))]
    lean = df.select(*[F.col(c).cast("double").alias(n) for c, n in zip(cols, named)])
    names = F.array(*[F.lit(c) for c in cols])
    pairs = pair_moments(lean, named)
    return pairs.select(F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), pair_correlation().alias("corr"))


def widest_columns(df: DataFrame, k: int = 30) -> list[str]:
    """The ``k`` numeric columns with the largest variance, for a readable matrix."""
    cols = numeric_cols(df)
    var = _long(df, {c: {"v": F.var_samp(F.col(c).cast("double"))} for c in cols})
    return [r["column"] for r in var.orderBy(F.desc_nulls_last("v"), "column").limit(k).collect()]


def histogram(df: DataFrame, col: str, bins: int = 50) -> DataFrame:
    """Equal-width bin counts between minimum and maximum; the maximum falls in the last bin."""
    x = F.col(col).cast("double")
    s = scalar_stats(df, lo=F.min(x), hi=F.max(x))
    lo, hi = s["lo"], s["hi"]
    raw = F.floor((x - lo) / F.nullif(hi - lo, F.lit(0.0)) * bins)
    b = F.coalesce(F.least(raw, F.lit(bins - 1)), F.lit(0)).cast("long")
    return df.filter(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("count"))


def missing_report(df: DataFrame) -> DataFrame:
    """Share of nulls per column that has any."""
    share = {c: {"missing_pct": F.avg(F.col(c).isNull().cast("double")) * 100} for c in df.columns}
    return _long(df, share).filter(F.col("missing_pct") > 0)


def feature_vs_target(df: DataFrame, x: str, y: str, fraction: float | None = None, seed: int = 0) -> DataFrame:
    """Chart data: complete pairs of a numeric feature, or target quartiles per category."""
    both = df.select(x, y).dropna()
    if kind(df.schema[x].dataType) == "numeric":
        return both.sample(fraction=fraction, seed=seed) if fraction else both
    quart = exact_quantiles(both, y, (0.0, 0.25, 0.5, 0.75, 1.0), [x])
    out = both.groupBy(x).agg(F.count("*").alias("count")).join(quart, x)
    return out.select(
        x, "count", *[F.element_at("q", i + 1).alias(n) for i, n in enumerate(("min", "q1", "median", "q3", "max"))]
    )


def preview(df: DataFrame, simple: bool = False, k: int = 10) -> DataFrame:
    """One text line per column: range and distinct values of numerics, up to ``k`` values of others.

    ``simple`` keeps the first 15 columns and leaves out the values.
    """
    cols = df.columns[:15] if simple else df.columns
    stats = profile_columns(df, cols)
    number = lambda c: F.format_string("%.6g", F.col(c))
    line = F.when(
        F.col("kind") == "numeric",
        F.concat_ws(" ", "column", F.lit("numeric"), F.lit("range"), number("min"), F.lit("to"), number("max"),
                    F.concat(F.lit("nulls "), F.col("nulls").cast("string"))),
    ).otherwise(F.concat_ws(" ", F.col("column"), F.col("kind"), F.lit("unique"), F.col("n_unique").cast("string")))
    if simple:
        return stats.select("column", line.alias("line"))
    others = [c for c in cols if kind(df.schema[c].dataType) == "categorical"]
    if not others:
        return stats.select("column", line.alias("line"))
    shown = top_values(df, others, k).groupBy("column").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda s: s["value"]), "|").alias("values")
    )
    full = F.concat_ws(" values ", line, F.col("values"))
    return stats.join(F.broadcast(shown), "column", "left").select("column", full.alias("line"))


def inventory(train: DataFrame, test: DataFrame, entity: str) -> DataFrame:
    """Rows and entities per split with the column list."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias("rows"), F.count_distinct(entity).alias("entities")).select(
            F.lit(name).alias("split"), "rows", "entities", F.lit(",".join(df.columns)).alias("columns")
        )

    return side(train, "train").unionByName(side(test, "test"))


