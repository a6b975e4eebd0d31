"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
import string
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one Arrow batch that are Python objects at the same time.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def crc_remainder(c: Column, modulus: int) -> Column:
    """crc32 of the value as text, modulo ``modulus``; null for null."""
    return F.crc32(c.cast("string")) % modulus


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def slices_by_bytes(batches: Iterator[pa.RecordBatch], column: int, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Stretches of rows whose binary ``column`` holds about ``size`` bytes; a longer value comes alone."""
    for batch in batches:
        if batch.num_rows:
            total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:
                before = total[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(total, before + size, side="right")))
                yield batch.slice(at, end - at)
                at = end


def give_back() -> None:
    """Return freed memory to the system: Python workers live on from task to task and share an executor's memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for mapInArrow, followed by :func:`give_back` once its caches are gone."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def map_rows(df: DataFrame, columns: list[str], out: str, fn: Callable[..., tuple]) -> DataFrame:
    """Replace the columns of each row by ``fn(*values)``, a tuple in the order of the DDL schema ``out``.

    Works on short slices of Arrow batches, so that few texts are Python objects at a time.
    """
    from pyspark.sql.types import _parse_datatype_string
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_parse_datatype_string(out))

    def run(batches):
        for part in slices(batches):
            rows = [fn(*values) for values in zip(*(c.to_pylist() for c in part.columns))]
            arrays = [pa.array(list(v), type=f.type) for v, f in zip(zip(*rows), schema)] if rows else [pa.array([], type=f.type) for f in schema]
            yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return df.select(*columns).mapInArrow(tidy(run), out)


class HashCache(dict):
    """Value of ``fn`` for each key, computed once while it is remembered.

    Holds at most ``limit`` keys and ``size`` bytes, in two generations: when the younger half is full it becomes the older
    one, from which a key that is asked for again comes back. Keys of more than ``longest`` letters or bytes are never held.
    """

    def __init__(self, fn: Callable, limit: int = 400_000, size: int = 48 << 20, longest: int = 128):
        super().__init__()
        self.fn, self.limit, self.size, self.longest = fn, limit, size, longest
        self.held, self.older = 0, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.fn(key)
        value = self.older.pop(key, None)
        if value is None:
            value = self.fn(key)
        weight = 100 + sys.getsizeof(key) + sys.getsizeof(value)
        if 2 * len(self) >= self.limit or 2 * (self.held + weight) > self.size:
            self.older, self.held = self.copy(), 0
            self.clear()
        self.held += weight
        self[key] = value
        return value


def hash_sample(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """About ``rows`` rows and never more than that, chosen by a hash of ``keys``: nothing is sorted or shuffled."""
    n = df.count()
    part = F.xxhash64(*keys).bitwiseAND(F.lit((1 << 40) - 1))
    return (df if n <= rows else df.filter(part < int((1 << 40) * rows / n))).limit(rows)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton steps; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    weight = np.ones(len(y)) if weight is None else weight
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + penalty * w
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w
