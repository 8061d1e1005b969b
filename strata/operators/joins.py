"""Join operators for the star schema.

Dimension lookups are left outer equi-joins.  A dimension side is broadcast
only when the bytes of the columns it would ship were measured and are within a bound; beyond it the join is
left to the planner (sort-merge, with AQE free to switch to broadcast once it
has measured the side, and to split skewed partitions).
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of a dimension's projected columns that may be shipped to every task.
MAX_BROADCAST_BYTES = 200 << 20
# Besides its values a row of a broadcast hash table takes a row header, null bits, offsets and a pointer.
ROW_BYTES = 40


@dataclass(frozen=True)
class TableSize:
    """Measured size of a stored table: rows, and bytes of the values of each column."""
    rows: int
    column_bytes: dict[str, int] = field(default_factory=dict)

    def of(self, columns: Sequence[str]) -> int:
        """Bytes of a hash table of these columns (a column that was not measured counts 100 bytes a row)."""
        return sum(self.column_bytes.get(c, 100 * self.rows) for c in set(columns)) + ROW_BYTES * self.rows


def fits(size: TableSize | None, columns: Sequence[str], max_bytes: int = MAX_BROADCAST_BYTES) -> bool:
    """True when ``columns`` of a table of that size may be broadcast."""
    return size is not None and size.of(columns) <= max_bytes


def sized_broadcast(df: DataFrame, columns: Sequence[str], size: TableSize | None, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` when ``columns`` of its table are measured and within ``max_bytes``, else ``df``."""
    return F.broadcast(df) if fits(size, columns, max_bytes) else df


def lookup(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str, take: Sequence[str],
           size: TableSize | None = None, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """``fact LEFT JOIN dim ON fact_key = dim_key``, adding ``take`` columns.

    Fan-out is not prevented: a duplicated ``dim_key`` multiplies fact rows,
    exactly as the SQL join does (the uniqueness checks report it).
    """
    side = dim.select(dim[dim_key].alias("_lookup_key"), *[dim[c] for c in take])
    side = sized_broadcast(side, [dim_key, *take], size, max_bytes)
    out = fact.join(side, fact[fact_key] == side["_lookup_key"], "left")
    return out.drop("_lookup_key")


def orphans(fact: DataFrame, dim: DataFrame, key: str, size: TableSize | None = None,
            max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """Fact rows whose ``key`` has no dimension row; NULL keys are orphans too."""
    side = sized_broadcast(dim.select(key), [key], size, max_bytes)
    return fact.join(side, key, "left_anti")
