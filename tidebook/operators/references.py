"""References to records that do not exist, found per null mask of a composite key.

References are grouped by which of their key columns are null, and each group is matched on its
non-null columns only, under declared match semantics:

* ``simple``: a reference with any null column refers to nothing and is never an orphan;
* ``partial``: the non-null columns must match those of some target (all null: never an orphan);
* ``full``: a reference that mixes nulls and values is an orphan, all null never is.

Without an order the match is one left anti join for all masks: the mask is part of the key, and a
target comes once for every mask that occurs, with the columns the mask leaves. Targets are reduced to
their distinct keys before they meet the references, so a key repeated in a third of the target rows is
one row; a key repeated among the references is split by the adaptive skew join. Where targets begin
and end (``orphans_in_time``) a reference must find its target alive at its own place in the order: the
anti join is then an ordered merge per key, linear in the rows whatever a key's history, and keys with
more rows than a task should hold are merged in blocks of the order.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.operators.carry import carry_max
from tidebook.operators.hot import HOT_ROWS, hot_keys


def null_mask(columns: Sequence[str]) -> Column:
    """Bit i is set where column i is null."""
    return reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)])


def kept(columns: Sequence[str], mask: int) -> list[str]:
    return [c for i, c in enumerate(columns) if not mask >> i & 1]


def missing_references(refs: DataFrame, targets: DataFrame, columns: Sequence[str], *, match: str = "simple") -> DataFrame:
    """The rows of ``refs`` whose ``columns`` match no row of ``targets`` (which has columns of the
    same names), under ``match``. Every row comes out at most once and whole, repeated rows each;
    other columns of ``targets`` are not read. No targets: every reference that refers is missing."""
    if match not in ("simple", "partial", "full"):
        raise ValueError(f"unknown match semantics: {match}")
    every = (1 << len(columns)) - 1
    masked = refs.withColumn("__mask", null_mask(columns))
    masks = sorted(r[0] for r in masked.select("__mask").distinct().collect())  # at most 2 ** len(columns)
    matched = [m for m in masks if m != every and (not m or match == "partial")]
    known = {m: reduce(and_, [F.col(c).isNotNull() for c in kept(columns, m)]) for m in matched}
    found = refs.limit(0)
    if matched:
        # a null takes the place of the columns that a mask leaves out, on both sides
        each = F.explode(F.array_compact(F.array(*[F.when(known[m], F.lit(m)) for m in matched])))
        there = targets.select(*columns, each.alias("__m"))
        there = there.select("__m", *[F.when(F.col("__m").bitwiseAND(1 << i) == 0, F.col(c)).alias(f"__t_{c}") for i, c in enumerate(columns)]).distinct()
        on = [F.col("__mask") == F.col("__m"), *[F.col(c).eqNullSafe(F.col(f"__t_{c}")) for c in columns]]
        found = masked.where(F.col("__mask").isin(*matched)).join(there, on, "left_anti").drop("__mask")
    if match == "full":
        found = found.unionAll(masked.where((F.col("__mask") != 0) & (F.col("__mask") != every)).drop("__mask"))
    return found


def orphans_in_time(rows: DataFrame, columns: Sequence[str], order: str, *, period: Sequence[str], hot_rows: int = HOT_ROWS, order_block: int = 1 << 16) -> DataFrame:
    """References without a live target at their place in the order.

    ``rows`` holds references, births and ends together: ``columns`` name the target, ``is_ref``
    says that the row refers to it, ``born`` and ``ended`` hold ``order`` where the row begins or
    ends it, whether or not that took effect. A reference is an orphan if at smaller ``order`` there
    is no birth, or the last end is greater than the last birth; rows at an equal ``order`` do not
    count. Partial match semantics: a reference with nulls is matched on its other columns, one with
    the last column (the identifier itself) null names nothing. ``order`` compares within ``period``
    only; a mask that lacks one of these columns is matched by existence. Rows with a null ``order``
    have no place in it and are left out. Returns the orphan rows of ``rows``, each as often as stored."""
    ident = columns[-1]
    masked = rows.where(F.col(order).isNotNull() & F.col(ident).isNotNull()).withColumn("__mask", null_mask(columns))
    out: list[DataFrame] = []
    masks = sorted(r[0] for r in masked.where("is_ref").select("__mask").distinct().collect())  # at most 2 ** len(columns)
    for m in masks:
        on = kept(columns, m)
        refs = masked.where((F.col("__mask") == m) & F.col("is_ref"))
        if m and not set(period) <= set(on):
            born = masked.where(F.col("born").isNotNull())
            out.append(missing_references(refs.drop("__mask"), born, on, match="partial"))
            continue
        # rows with this mask's columns, null-free: those of other masks are targets only
        side = masked.where(reduce(and_, [F.col(c).isNotNull() for c in on])) if m else masked.where(F.col("__mask") == 0)
        side = side.where((F.col("__mask") == m) | F.col("born").isNotNull() | F.col("ended").isNotNull()).withColumn("is_ref", F.col("is_ref") & (F.col("__mask") == m)).drop("__mask")
        hot = hot_keys(side, on, hot_rows)
        blocks = F.expr(f"`{order}` div {order_block}")
        ways = [(side, None)] if hot is None else [(hot.others(side), None), (hot.of(side), blocks)]
        for part, block in ways:
            seen = carry_max(part, on, order, ["born", "ended"], strict=True, block=block)
            out.append(seen.where(F.col("is_ref") & (F.col("born").isNull() | (F.col("ended") > F.col("born")))))
    if not out:
        return masked.drop("__mask").limit(0)
    return reduce(lambda a, b: a.unionByName(b), [o.select(*rows.columns) for o in out])
