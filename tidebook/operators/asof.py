"""Attributes as known at event time."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.operators.carry import carry_max

#: Width of a time block, ns: an entity's day is spread over 48 tasks or more.
BLOCK_NS = 1_800_000_000_000


def attributes_at(events: DataFrame, changes: Mapping[str, DataFrame], entity: Sequence[str], event_time: str, *, holds_from: str, known_from: str, version: Sequence[str], payload: str, block_ns: int = BLOCK_NS) -> DataFrame:
    """``events`` with one struct column per entry of ``changes``: the change of the same entity
    with both ``holds_from`` and ``known_from`` at most the event's time that has the greatest
    (``holds_from``, *``version``); its fields are ``holds_from``, ``version`` and ``payload``.

    Events and changes are united and sorted by entity and availability time, the later of the
    two times of a change; at equal times changes come before events. What is carried forward is
    the greatest change so far, so one learnt late never displaces one that holds from later on,
    and nothing learnt after the event is seen.

    Events with a null entity column or time, and events before any change, get null structs.
    Changes with a null entity, ``holds_from`` or ``known_from`` are never seen; callers leave out
    changes that set nothing. Rows stored twice do no harm: equal changes are one maximum, and every
    event row comes out once. Columns of the changes never meet those of the events, so clashing
    names are safe; an event column named like an entry of ``changes`` is replaced."""
    names = list(changes)
    keyed = events.select(*[c for c in events.columns if c not in names])
    row = F.struct(*[F.col(c) for c in keyed.columns]).alias("__row")
    known = [F.col(e).isNotNull() for e in entity] + [F.col(event_time).isNotNull()]
    usable = known[0]
    for k in known[1:]:
        usable = usable & k
    keys = [F.col(e).alias(f"__e{i}") for i, e in enumerate(entity)]
    ids = [f"__e{i}" for i in range(len(entity))]
    united = keyed.where(usable).select(*keys, F.col(event_time).cast("long").alias("__at"), F.lit(1).alias("__prio"), row)
    for name, ch in changes.items():
        fine = ch.where(F.col(holds_from).isNotNull() & F.col(known_from).isNotNull())
        for e in entity:
            fine = fine.where(F.col(e).isNotNull())
        change: Column = F.struct(F.col(holds_from), *[F.col(v) for v in version], F.col(payload)).alias(name)
        united = united.unionByName(fine.select(*keys, F.greatest(holds_from, known_from).cast("long").alias("__at"), F.lit(0).alias("__prio"), change), allowMissingColumns=True)
    carried = carry_max(united, ids, "__at", names, priority="__prio", block=F.expr(f"__at div {int(block_ns)}"))
    seen = carried.where(F.col("__prio") == 1).select("__row.*", *names)
    return seen.unionByName(keyed.where(~usable), allowMissingColumns=True)
