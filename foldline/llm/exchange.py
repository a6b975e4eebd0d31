"""Joining many small keys in few rows: sorted key arrays go to key ranges and come back with an answer for each key."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from foldline.llm.common import give_back, tidy

#: Keys that one task should reduce at most.
TASK_KEYS = 1_500_000


def _squeeze(values: np.ndarray) -> bytes:
    """Eight-byte numbers, byte plane by byte plane, compressed: small numbers cost next to nothing."""
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack_column(packed: bytes, dtype) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(dtype).reshape(-1)


def pack_column(values: np.ndarray) -> bytes:
    return _squeeze(values)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit keys, as differences."""
    return _squeeze(np.diff(keys, prepend=np.uint64(0)).astype("<u8"))


def unpack_keys(packed: bytes) -> np.ndarray:
    return np.cumsum(unpack_column(packed, "<u8"), dtype=np.uint64)


def range_bits(total_keys: int) -> int:
    """Logarithm of the number of key ranges: as many as keep a range near ``TASK_KEYS`` keys."""
    return max(3, int(np.ceil(np.log2(max(1, total_keys / TASK_KEYS)))))


def dealt(batches: DataFrame, bits: int) -> DataFrame:
    """(range, batch, keys, columns): each row of ``batches`` (batch, keys, columns) cut by the top ``bits`` of its keys."""

    def deal(parts):
        for rows in parts:
            for batch, packed, columns in zip(*(c.to_pylist() for c in rows.columns)):
                keys = unpack_keys(packed)
                values = [unpack_column(c, np.int64) for c in columns]
                at = np.searchsorted(keys, np.arange(1, 1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
                cuts = [0, *at.tolist(), len(keys)]
                spans = [(p, a, b) for p, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b]
                if spans:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p for p, _, _ in spans], pa.int64()), pa.array([batch] * len(spans), pa.int64()),
                            pa.array([pack_keys(keys[a:b]) for _, a, b in spans], pa.binary()),
                            pa.array([[pack_column(v[a:b]) for v in values] for _, a, b in spans], pa.list_(pa.binary())),
                        ],
                        names=["range", "batch", "keys", "columns"],
                    )

    return batches.select("batch", "keys", "columns").mapInArrow(tidy(deal), "range long, batch long, keys binary, columns array<binary>")


def ask(batches: DataFrame, reduce: Callable[[np.ndarray, list[np.ndarray]], tuple[list[np.ndarray], int]], total_keys: int) -> DataFrame:
    """(batch, range, answers, total) for ``batches`` (batch, keys, columns): one row per batch, columns an array of packed int64 arrays.

    Keys of a batch are sorted and distinct. ``reduce(group, columns)`` gets the rows of all batches in one range of
    keys, ``group`` numbering equal keys from 0, and returns arrays in the order of the groups and a number to be summed over
    all ranges (in ``total``). Each batch gets the answers of its keys in the order of its keys. A key has at most one row per batch, however often it occurs, and
    hashed keys spread evenly, so ranges are alike in size; their number follows ``total_keys``.
    """

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack_keys(k) for k in pdf["keys"]]
        _, group = np.unique(np.concatenate(parts), return_inverse=True)
        columns = [np.concatenate([unpack_column(c[i], np.int64) for c in pdf["columns"]]) for i in range(len(pdf["columns"].iloc[0]))]
        found, total = reduce(group, columns)
        ends = np.cumsum([len(p) for p in parts])[:-1]
        split = [np.split(np.asarray(f, np.int64)[group], ends) for f in found]
        rows = [[pack_column(s[i]) for s in split] for i in range(len(parts))]
        del parts, group, columns, found, split
        give_back()
        return pd.DataFrame({"batch": pdf["batch"], "range": pdf["range"], "answers": rows, "total": [total, *[0] * (len(rows) - 1)]})

    return dealt(batches, range_bits(total_keys)).groupBy("range").applyInPandas(answer, "batch long, range long, answers array<binary>, total long")


def read_answers(answers: list, n: int) -> list[np.ndarray]:
    """The n answer columns of one batch, aligned with its keys, from its answers in the order of the ranges."""
    return [np.concatenate([unpack_column(a[i], np.int64) for a in answers]) if len(answers) else np.zeros(0, np.int64) for i in range(n)]
