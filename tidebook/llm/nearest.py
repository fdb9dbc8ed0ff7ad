"""Pairing records with the nearest one in time, by tick expansion.

Time is cut into ticks as long as the tolerance. Right records are exploded to every tick from
which one within tolerance can be seen, that is their own and at most one on either side. Per entity
and tick only the latest from the tick before and the earliest from the tick after are kept, since
whatever a left record's place in the tick, no other from outside can be nearer. Left records meet
these by an equi-join on entity and tick. Timestamps are finer than ticks here, so records in the
left record's own tick are not reduced to one: the last at or before and the first at or after it
come from one sort of the tick each way. No pair is made that is not a candidate, and a hot entity
is spread over its ticks.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nearest(left: DataFrame, right: DataFrame, entity: Sequence[str], time: str, right_id: str, tolerance: int) -> DataFrame:
    """Every row of ``left`` with ``nearest_id`` and ``nearest_time``: the row of ``right`` of the
    same ``entity`` (names in both tables) whose ``time`` differs least, by ``tolerance`` at most;
    on equal differences the earlier time, then the smaller ``right_id``.

    Left rows with a null entity column or time, or without a partner, get nulls; right rows with a
    null among these columns are never partners. Repeated left rows come out as often as stored,
    repeated right rows are one candidate. Other right columns are not read, so names may clash."""
    w = int(tolerance) if tolerance > 0 else 1
    ids = [f"__e{i}" for i in range(len(entity))]
    keys = [F.col(e).alias(n) for e, n in zip(entity, ids)]
    usable = reduce(and_, [F.col(c).isNotNull() for c in [*entity, time]])
    cell = lambda t: F.expr(f"({t} - pmod({t}, {w}L)) div {w}L")  # noqa: E731  exact floor for negatives too
    rows = left.where(usable).select(*keys, F.col(time).cast("long").alias("__t"), F.struct(*left.columns).alias("__row")).withColumn("__tick", cell("__t"))
    r = right.where(usable & F.col(right_id).isNotNull()).select(*keys, F.col(time).cast("long").alias("__t"), F.col(right_id).alias("__id"))
    seen = r.withColumn("__own", cell("__t")).withColumn("__tick", F.explode(F.sequence(cell(f"(__t - {int(tolerance)}L)"), cell(f"(__t + {int(tolerance)}L)"))))
    # nearest from outside, per entity and tick
    early = F.struct((-F.col("__t")).alias("t"), F.col("__id").alias("id"))
    late = F.struct(F.col("__t").alias("t"), F.col("__id").alias("id"))
    outside = (
        seen.where("__tick <> __own")
        .groupBy(*ids, "__tick")
        .agg(F.min(F.when(F.col("__own") < F.col("__tick"), early)).alias("__before"), F.min(F.when(F.col("__own") > F.col("__tick"), late)).alias("__after"))
    )
    joined = rows.join(outside, [*ids, "__tick"], "left")
    # nearest inside the tick: one sort each way over left and right rows of the tick together
    both = joined.withColumn("__id", F.lit(None).cast(dict(r.dtypes)["__id"])).unionByName(seen.where("__tick = __own").drop("__own"), allowMissingColumns=True)
    tick_rows = Window.partitionBy(*ids, "__tick")
    upto = tick_rows.orderBy("__t").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    downto = tick_rows.orderBy(F.desc("__t")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("__last", F.min(F.when(F.col("__id").isNotNull(), early)).over(upto)).withColumn("__first", F.min(F.when(F.col("__id").isNotNull(), late)).over(downto))
    cands = F.array(
        *[F.when(F.col(c).isNotNull(), F.struct((F.col("__t") + F.col(f"{c}.t")).alias("diff"), (-F.col(f"{c}.t")).alias("t"), F.col(f"{c}.id").alias("id"))) for c in ("__before", "__last")],
        *[F.when(F.col(c).isNotNull(), F.struct((F.col(f"{c}.t") - F.col("__t")).alias("diff"), F.col(f"{c}.t").alias("t"), F.col(f"{c}.id").alias("id"))) for c in ("__first", "__after")],
    )
    best = placed.where("__row IS NOT NULL").withColumn("__best", F.array_min(F.array_compact(cands)))
    best = best.withColumn("__best", F.when(F.col("__best.diff") <= int(tolerance), F.col("__best")))
    found = best.select("__row.*", F.col("__best.id").alias("nearest_id"), F.col("__best.t").alias("nearest_time"))
    return found.unionByName(left.where(~usable), allowMissingColumns=True)
