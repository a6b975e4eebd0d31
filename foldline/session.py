"""Session defaults and lineage cutting."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "foldline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` overrides them.

    Keys in ``conf`` use ``__`` for dots, e.g. ``spark__sql__shuffle__partitions="64"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def small_methods(spark: SparkSession) -> Iterator[None]:
    """Jobs that run inside generate no method beyond 8,000 bytes, which the JVM would never compile but interpret.

    Very wide projections are then generated in many small methods. The session's own setting comes back at the end.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key)
    spark.conf.set(key, "8000")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediates: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back to a folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="spark-foldline-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


#: Intermediates of this process, deleted at its end.
_WRITTEN: list[str] = []


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a written folder, wherever its file system is."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _clear(spark: SparkSession) -> None:
    """Delete what is left of the intermediates; the JVM may be gone before, then the folder's owner has to."""
    for path in _WRITTEN:
        try:
            delete_path(spark, path)
        except Exception:  # noqa: BLE001 - the process is ending
            return


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and continue from the written table.

    The result survives executor loss, and values that depend on the physical layout
    (partition ids, sort positions) are frozen by the write.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark).rstrip('/')}/cut-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clear, spark)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete written tables that nothing reads any more: everything made from them must have been written, too."""
    for df in frames:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith("cut-"):
                delete_path(spark, path)
