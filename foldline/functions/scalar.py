"""Row-level column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def map_values(col: Column, table: Mapping, default) -> Column:
    """Lookup in a small literal map with a default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col), F.lit(default))


def zero_safe_ratio(a: Column, b: Column) -> Column:
    """``a / b``; null where ``b`` is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def bin_fixed(col: Column, edges: Sequence[float], default: float) -> Column:
    """Right-closed bins numbered from 0; null and out-of-range values get the default."""
    out = F.lit(float(default))
    for code in range(len(edges) - 2, -1, -1):
        inside = (col > edges[code]) & (col <= edges[code + 1])
        out = F.when(inside, F.lit(float(code))).otherwise(out)
    return out


def split_id(col: Column) -> tuple[Column, Column]:
    """Entity and row number of ``entity_row``, split at the last underscore."""
    return (
        F.regexp_extract(col, r"^(.*)_([^_]*)$", 1),
        F.regexp_extract(col, r"^(.*)_([^_]*)$", 2).try_cast("long"),
    )


def row_id(entity: Column, row: Column) -> Column:
    return F.concat_ws("_", entity.cast("string"), row.cast("string"))


def same_day(ts: Column, day: Column) -> Column:
    """Whether an ISO timestamp falls on a calendar day."""
    return F.to_date(ts) == day.cast("date")


def next_reset(ts: Column) -> Column:
    """First day on which a daily budget is fresh again."""
    return F.date_add(F.to_date(ts), 1)


def soft_clip01(col: Column, lo: float, width: float) -> Column:
    """``(col - lo) / width`` limited to [0, 1]."""
    return F.least(F.greatest((col - lo) / width, F.lit(0.0)), F.lit(1.0))
