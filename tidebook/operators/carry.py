"""Carrying the greatest known value forward along an order, for entities of any size.

``carry_max`` gives each row, per entity and in a declared order, the greatest value of some
columns over the rows up to it. An entity's rows are split by blocks of the order, so one that
holds a third of the table is spread over as many tasks as it has blocks: each block is first
reduced to its maxima (partially on the map side), the few block rows of an entity are scanned for
what each block inherits, and the inherited values enter their block as one more row at its start.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def carry_max(rows: DataFrame, entity: Sequence[str], order: str, values: Sequence[str], *, priority: str | None = None, strict: bool = False, block: Column | None = None) -> DataFrame:
    """``rows`` with each of ``values`` replaced by its greatest value over the entity's rows up to
    that row: rows with a smaller ``order``, and, unless ``strict``, those with an equal one whose
    ``priority`` is not greater (all of them without a priority). Nulls are skipped; a row that
    nothing precedes gets null. ``order`` must not be null. Null entities form an entity of their
    own. ``block``, a column that never decreases as ``order`` grows, splits entities."""
    own = [*entity, *(["__block"] if block is not None else [])]
    by = Window.partitionBy(*own).orderBy(*([order, priority] if priority is not None and not strict else [order]))
    run = by.rangeBetween(Window.unboundedPreceding, -1 if strict else Window.currentRow)
    marked = rows
    if block is not None:
        blocked = rows.withColumn("__block", block)
        maxima = blocked.groupBy(*own).agg(*[F.max(v).alias(v) for v in values])
        earlier = Window.partitionBy(*entity).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
        inherited = maxima.select(*own, *[F.max(v).over(earlier).alias(v) for v in values]).where(reduce(or_, [F.col(v).isNotNull() for v in values]))
        # its null order sorts first, so every frame of the block holds it
        marked = blocked.withColumn("__carried", F.lit(False)).unionByName(inherited.withColumn("__carried", F.lit(True)), allowMissingColumns=True)
    out = marked.select(*[c for c in marked.columns if c not in values], *[F.max(v).over(run).alias(v) for v in values])
    return out if block is None else out.where(~F.col("__carried")).drop("__carried", "__block")
