"""Files as rows: fingerprints, inventories and hash contracts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldline.session import cut_lineage


#: Bytes of a file that one task row reads and hashes.
PART_BYTES = 64 << 20
#: Bytes held at once while a part is read.
STEP_BYTES = 4 << 20


def part_digests(files: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(path, length, part, sha)``: SHA-256 of each ``part_bytes`` of the files in ``(path, length)``.

    A row reads its own bytes only, so that neither a task nor a row ever holds a whole file.
    """
    last = F.greatest(F.floor((F.col("length") - 1) / part_bytes), F.lit(0)).cast("long")
    parts = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("part"))
    step = STEP_BYTES

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shas = []
            for row in batch.to_pylist():
                scheme, rest = row["path"].split(":", 1)
                source, path = pafs.FileSystem.from_uri(f"{scheme}:{quote(rest, safe='/:@')}")
                left, sha = min(part_bytes, row["length"] - row["part"] * part_bytes), hashlib.sha256()
                with source.open_input_file(path) as f:
                    f.seek(row["part"] * part_bytes)
                    while left > 0:
                        data = f.read(min(step, left))
                        if not data:
                            raise OSError(f"{row['path']} became shorter while it was read")
                        sha.update(data)
                        left -= len(data)
                shas.append(sha.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shas, pa.string())], names=["path", "length", "part", "sha"])

    # tasks grow with the files: two parts each on average
    count = files.agg(F.sum(F.greatest(F.ceil(F.col("length") / part_bytes), F.lit(1)))).first()[0] or 0
    tasks = max(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(count) // 2))
    return parts.repartition(tasks, "path", "part").mapInArrow(read, "path string, length long, part long, sha string")


def file_hashes(spark: SparkSession, paths: Sequence[str], mode: str = "content", glob: str | None = None, part_bytes: int = PART_BYTES) -> DataFrame:
    """``(path, name, length, digest)`` per file; ``metadata`` mode hashes name, size and mtime only.

    A content digest is the SHA-256 of name, part size and the SHA-256 of every part in order: it depends on the bytes alone, not on how
    Spark splits files, and files of any size are read in parts. Spark lists no empty files.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    files = reader.load(list(paths)).withColumn("name", F.element_at(F.split("path", "/"), -1))
    if mode == "metadata":
        digest = F.sha2(F.concat_ws(":", "name", "length", F.unix_micros("modificationTime")), 256)
        return files.select("path", "name", "length", digest.alias("digest"))
    if mode != "content":
        raise ValueError(f"unknown fingerprint mode {mode}")
    whole = part_digests(files.select("path", "length"), part_bytes).groupBy("path", "length").agg(F.array_sort(F.collect_list(F.struct("part", "sha"))).alias("parts"))
    name = F.element_at(F.split("path", "/"), -1)
    digest = F.sha2(F.concat_ws(":", name, F.lit(str(part_bytes)), F.transform("parts", lambda p: p["sha"])), 256)
    return whole.select("path", name.alias("name"), "length", digest.alias("digest"))


def snapshot(spark: SparkSession, paths: Sequence[str], mode: str = "content", glob: str | None = None) -> DataFrame:
    """File hashes as of now, written down so that a later comparison does not read the files again."""
    return cut_lineage(file_hashes(spark, paths, mode, glob))


def fingerprint(spark: SparkSession, paths: Sequence[str], mode: str = "content", glob: str | None = None) -> str:
    """One digest for a file set, independent of listing order.

    Each file digest is cut into four integers that are summed exactly, so files combine on any
    number of tasks and nothing is collected.
    """
    lanes = [
        F.sum(F.conv(F.substring("digest", 1 + 16 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string")
        for i in range(4)
    ]
    total = file_hashes(spark, paths, mode, glob).agg(
        F.sha2(F.concat_ws(":", F.count("*").cast("string"), *lanes), 256).alias("d")
    )
    return total.first()["d"]


def file_inventory(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """``(path, length, lines)`` of every file under ``root``."""
    binary = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    text = spark.read.option("recursiveFileLookup", True)
    if glob:
        binary, text = binary.option("pathGlobFilter", glob), text.option("pathGlobFilter", glob)
    sizes = binary.load(root).select("path", "length")
    lines = text.text(root).groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count("*").alias("lines"))
    return sizes.join(lines, "path", "left").fillna({"lines": 0})


def hash_contract(before: DataFrame, after: DataFrame) -> DataFrame:
    """Files whose digest changed, appeared or vanished between two :func:`snapshot` tables."""
    a = before.select("path", F.col("digest").alias("digest_before"))
    b = after.select("path", F.col("digest").alias("digest_after"))
    return a.join(b, "path", "full_outer").filter(~F.col("digest_before").eqNullSafe(F.col("digest_after")))
