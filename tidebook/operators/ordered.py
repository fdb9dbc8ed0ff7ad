"""Running sums, previous rows and runs of equal values along an order, without one task per key.

All three split a key's rows by blocks of the order: a block is reduced to one row (partially on
the map side), those few rows are scanned per key, and what a block inherits is joined to it. So a
key with a third of all rows is as many tasks as it has blocks. ``block`` must never decrease as
the order grows; ``order_block`` makes one.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 20


def order_block(order: str, size: int = BLOCK) -> Column:
    return F.expr(f"`{order}` div {int(size)}L")


def _same(keys: Sequence[str]) -> Column:
    return reduce(and_, [F.col(k).eqNullSafe(F.col(f"__o_{k}")) for k in keys])


def _inherit(rows: DataFrame, keys: Sequence[str], sums: DataFrame) -> DataFrame:
    """Join each block's row of ``sums`` (keys and __b renamed with __o_) to its rows."""
    own = [*keys, "__b"]
    return rows.join(sums.select(*[F.col(k).alias(f"__o_{k}") for k in own], *[c for c in sums.columns if c not in own]), _same(own), "left").drop(*[f"__o_{k}" for k in own])


def prefix_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column], block: Column, *, inclusive: bool = True) -> DataFrame:
    """``df`` with a running sum per entry of ``sums`` (name to value) over ``keys`` in ``order``,
    which must be total within a key. Null values add nothing; a sum starts at 0."""
    rows = df.withColumn("__b", block)
    for i, v in enumerate(sums.values()):
        rows = rows.withColumn(f"__v{i}", F.coalesce(v, F.lit(0)))
    own = [*keys, "__b"]
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*own).agg(*[F.sum(f"__v{i}").alias(f"__t{i}") for i in range(len(sums))])
    offsets = totals.select(*own, *[F.coalesce(F.sum(f"__t{i}").over(before), F.lit(0)).alias(f"__f{i}") for i in range(len(sums))])
    run = Window.partitionBy(*own).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = _inherit(rows, keys, offsets)
    out = out.select("*", *[(F.col(f"__f{i}") + F.coalesce(F.sum(f"__v{i}").over(run), F.lit(0))).alias(n) for i, n in enumerate(sums)])
    return out.drop("__b", *[f"__{x}{i}" for x in "vf" for i in range(len(sums))])


def previous(df: DataFrame, keys: Sequence[str], order: str, columns: Sequence[str], block: Column, name: str = "prev") -> DataFrame:
    """``df`` with struct ``name`` of the key's previous row's ``columns``, null on its first row.
    ``order`` must be total within a key."""
    rows = df.withColumn("__b", block).withColumn("__r", F.struct(*columns))
    own = [*keys, "__b"]
    last = rows.groupBy(*own).agg(F.max_by("__r", order).alias("__last"))
    inherited = last.select(*own, F.lag("__last").over(Window.partitionBy(*keys).orderBy("__b")).alias("__in"))
    out = _inherit(rows, keys, inherited)
    return out.withColumn(name, F.coalesce(F.lag("__r").over(Window.partitionBy(*own).orderBy(order)), F.col("__in"))).drop("__b", "__r", "__in")


def runs(df: DataFrame, keys: Sequence[str], order: str, value: str, aggregates: Sequence[tuple[str, str, Column]], block: Column) -> DataFrame:
    """One row per maximal run of equal ``value`` along ``order``: keys, ``value``, ``run`` (from 0
    within a key), ``first_order``, ``last_order`` and the aggregates. Each aggregate is (name,
    how, column) with how one of first, last, min, max, sum, count. A value met again later is a new
    run. Runs are found within blocks first, then the pieces of neighbouring blocks are joined."""
    rows = df.withColumn("__b", block)
    for i, (_, _, c) in enumerate(aggregates):
        rows = rows.withColumn(f"__a{i}", c)
    inner = Window.partitionBy(*keys, "__b").orderBy(order)
    changed = (~F.col(value).eqNullSafe(F.lag(value).over(inner))) | (F.row_number().over(inner) == 1)
    rows = rows.withColumn("__new", changed.cast("int")).withColumn("__piece", F.sum("__new").over(inner.rowsBetween(Window.unboundedPreceding, 0)))

    def merge(i: int, how: str, first: Column, last: Column, counting: bool) -> Column:
        a = F.col(f"__a{i}")
        if how == "first":
            return F.min_by(a, first)
        if how == "last":
            return F.max_by(a, last)
        if how == "count":
            return F.count(a) if counting else F.sum(a)
        return {"min": F.min, "max": F.max, "sum": F.sum}[how](a)

    o = F.col(order)
    pieces = rows.groupBy(*keys, "__b", "__piece", value).agg(F.min(o).alias("__lo"), F.max(o).alias("__hi"), *[merge(i, h, o, o, True).alias(f"__a{i}") for i, (_, h, _) in enumerate(aggregates)])
    outer = Window.partitionBy(*keys).orderBy("__lo")
    fresh = (~F.col(value).eqNullSafe(F.lag(value).over(outer))) | (F.row_number().over(outer) == 1)
    pieces = pieces.withColumn("__new", fresh.cast("int")).withColumn("run", F.sum("__new").over(outer.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    lo, hi = F.col("__lo"), F.col("__hi")
    return pieces.groupBy(*keys, "run", value).agg(F.min(lo).alias("first_order"), F.max(hi).alias("last_order"), *[merge(i, h, lo, hi, False).alias(n) for i, (n, h, _) in enumerate(aggregates)])
