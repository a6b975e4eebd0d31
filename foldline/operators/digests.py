"""Tables compared by digests of their buckets: rows move only where the digests differ."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 4096
#: Two 64-bit hashes of a row in pieces of sixteen bits: sums of 2^47 rows still fit a long.
LANES = tuple(f"s{i}" for i in range(8))


def _aligned(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with the same positional names and the types a union gives them."""
    if len(a.columns) != len(b.columns):
        raise ValueError(f"{len(a.columns)} columns against {len(b.columns)}")
    names = [f"c{i}" for i in range(len(a.columns))]
    types = [f.dataType for f in a.toDF(*names).union(b.toDF(*names)).schema]
    cast = lambda df: df.toDF(*names).select(*[F.col(n).cast(t).alias(n) for n, t in zip(names, types)])
    return cast(a), cast(b), names


def _marked(c: Column, t: T.DataType) -> list[Column]:
    """What to hash of a value: the hash function skips nulls and runs arrays together, so nulls and sizes are marked at every depth."""
    if isinstance(t, T.ArrayType):
        return [c.isNull(), F.size(c), F.transform(c, lambda x: F.struct(*_marked(x, t.elementType)))]
    if isinstance(t, T.StructType):
        return [c.isNull(), *[x for f in t.fields for x in _marked(c.getField(f.name), f.dataType)]]
    return [c.isNull(), c]


def _hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a row."""
    marked = [x for f in df.schema.fields for x in _marked(F.col(f.name), f.dataType)]
    return F.xxhash64(F.lit(1), *marked), F.xxhash64(F.lit(2), *reversed(marked))


def _bucket(df: DataFrame, buckets: int) -> Column:
    return F.pmod(_hashes(df)[0], F.lit(buckets)).cast("int")


def _digests(df: DataFrame, buckets: int) -> DataFrame:
    pieces = [F.shiftrightunsigned(h, 16 * k).bitwiseAND(F.lit(0xFFFF)) for h in _hashes(df) for k in range(4)]
    return df.groupBy(_bucket(df, buckets).alias("bucket")).agg(F.count("*").alias("rows"), *[F.sum(p).alias(s) for p, s in zip(pieces, LANES)])


def table_digests(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``(bucket, rows, s0..s7)``: order-free digest of the multiset of rows of each bucket.

    One scan and one exchange of at most ``buckets`` rows a task; stored, it stands for the table in a later comparison.
    """
    names = [f"c{i}" for i in range(len(df.columns))]
    return _digests(df.toDF(*names), buckets)


def differing_buckets(a: DataFrame, b: DataFrame) -> DataFrame:
    """Buckets whose digests differ, of two tables of :func:`table_digests` (with the same number of buckets)."""
    sums = ("rows", *LANES)
    both = a.select("bucket", *[F.col(s).alias(f"a_{s}") for s in sums]).join(b.select("bucket", *[F.col(s).alias(f"b_{s}") for s in sums]), "bucket", "full_outer")
    same = reduce(lambda x, y: x & y, [F.col(f"a_{s}").eqNullSafe(F.col(f"b_{s}")) for s in sums])
    return both.filter(~same).select("bucket")


def same_rows(a: DataFrame, b: DataFrame, buckets: int = BUCKETS) -> bool:
    """Whether both tables hold the same rows equally often, columns by position; no row is shuffled."""
    x, y, _ = _aligned(a, b)
    return differing_buckets(_digests(x, buckets), _digests(y, buckets)).isEmpty()


def row_differences(a: DataFrame, b: DataFrame, side: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Rows of one side that the other has less often, each as often as it is missing: ``exceptAll`` both ways.

    Digests of buckets are compared first, and only rows of buckets that differ (at most ``buckets`` ids, sent to all tasks)
    are counted, once for both directions. ``side`` names an added column, ``left`` or ``right``. Columns go by position
    and keep the names of ``a``. Both tables are read twice, so their values must not depend on the physical layout.
    """
    x, y, names = _aligned(a, b)
    differ = F.broadcast(differing_buckets(_digests(x, buckets), _digests(y, buckets)))

    def suspects(df: DataFrame, sign: int) -> DataFrame:
        return df.withColumn("bucket", _bucket(df, buckets)).join(differ, "bucket", "left_semi").select(*names, F.lit(sign).alias("sign"))

    excess = suspects(x, 1).unionByName(suspects(y, -1)).groupBy(*names).agg(F.sum("sign").alias("excess")).filter("excess <> 0")
    out = excess.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.abs("excess"))))
    shown = [F.col(n) for n in names]
    if side is None:
        return out.select(*shown).toDF(*a.columns)
    return out.select(*shown, F.when(F.col("excess") > 0, "left").otherwise("right")).toDF(*a.columns, side)
