"""Keys with more rows than one task should hold, found exactly and without counting every key.

Rows are first counted by hash bucket, partially on the map side, and only buckets with more rows than
a key may have leave the tasks. Keys are then counted in these buckets alone. The bound is a number of
rows, the same however large the table; where it is large, all buckets pass it and all keys are counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.runtime import materialize

BUCKETS = 65_536
#: A key of more rows is split.
HOT_ROWS = 1_000_000
#: Hot keys are broadcast up to this many; there are at most rows / HOT_ROWS.
FEW = 100_000
#: Buckets are named in a filter up to this many.
NAMED = 1_000


@dataclass
class Hot:
    """``table``: the hot keys, each once; ``n`` of them."""

    keys: list[str]
    table: DataFrame
    n: int

    def of(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._side(), self.keys, "left_semi")

    def others(self, rows: DataFrame) -> DataFrame:
        return rows.join(self._side(), self.keys, "left_anti")

    def _side(self) -> DataFrame:
        return F.broadcast(self.table) if self.n <= FEW else self.table


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> Hot | None:
    """The combinations of ``keys`` with more than ``hot_rows`` rows; None without any. Rows with a null
    in a key count for none. The driver sees at most BUCKETS numbers."""
    known = rows.select(*keys).dropna()
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")
    full = [r["b"] for r in known.groupBy(bucket.alias("b")).count().where(F.col("count") > hot_rows).collect()]
    if not full:
        return None
    suspects = known.where(bucket.isin(full)) if len(full) <= NAMED else known
    table = materialize(suspects.groupBy(*keys).count().where(F.col("count") > hot_rows).select(*keys), "hot")
    n = table.count()
    return Hot(list(keys), table, n) if n else None
