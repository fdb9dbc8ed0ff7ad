"""The simple single-symbol ladder, kept for its differences from ``book``: taking off more than an
order has is not bounded but wraps at 32 bits, a reference added again points to the newer order
while the older stays in its level, and locates are ignored. Correct feeds give the same levels."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators.book import book_rows
from tidebook.runtime import materialize

LEVELS = "session_date date, side string, price long, shares long, order_count int"
_WRAP = 1 << 32


class Ladder:
    def __init__(self, symbol: str):
        self.symbol = symbol
        self.orders: dict[int, list] = {}  # ref: [side, shares, price]
        self.levels: dict[tuple, list] = {}  # (side, price): [shares, orders]

    def add(self, ref: int, side: str, shares: int, price: int) -> None:
        side = "B" if side == "B" else "S"
        level = self.levels.setdefault((side, price), [0, 0])
        level[0] = (level[0] + shares) % _WRAP
        level[1] += 1
        self.orders[ref] = [side, shares, price]

    def take(self, ref: int, shares: int | None) -> None:
        o = self.orders.get(ref)
        if o is None:
            return
        shares = o[1] if shares is None else shares
        level = self.levels[o[0], o[2]]
        level[0] = (level[0] - shares) % _WRAP
        o[1] = (o[1] - shares) % _WRAP
        if not o[1]:
            level[1] -= 1
            if not level[1]:
                del self.levels[o[0], o[2]]
            del self.orders[ref]

    def step(self, t: str, stock: str, ref: int, new: int, side: str, shares: int, price: int) -> None:
        if t in "AF":
            if stock == self.symbol:
                self.add(ref, side, shares, price)
        elif t == "D":
            self.take(ref, None)
        elif t == "U":
            o = self.orders.get(ref)
            if o:
                self.take(ref, None)
                self.add(new, o[0], shares, price)
        elif t in "ECX":
            self.take(ref, shares)


def ladder(messages: DataFrame, symbol: str) -> DataFrame:
    """Levels of ``symbol`` at the end of each session. The fold is over one symbol's adds and the
    changes of their references and of those that replaced these, found first, as it must not trust
    locates; sessions run in parallel."""
    cols = ["session_date", "message_type", "stock", "ref", "new_ref", "side", "shares", "price"]
    every = book_rows(messages).where(F.col("message_type").isin(*"AFECXDU"))
    adds = every.where(F.col("message_type").isin("A", "F") & (F.col("stock") == symbol))
    changes = every.where(~F.col("message_type").isin("A", "F"))
    replaced = changes.where("message_type = 'U'").select(F.col("session_date").alias("d"), "ref", "new_ref")
    known = materialize(adds.select(F.col("session_date").alias("d"), "ref").distinct(), "ladder")
    edge = known
    while True:  # as often as the longest chain of replacements
        found = replaced.join(edge, replaced.d.eqNullSafe(edge.d) & (replaced.ref == edge.ref), "left_semi").select("d", F.col("new_ref").alias("ref")).distinct()
        edge = materialize(found.join(known, found.d.eqNullSafe(known.d) & (found.ref == known.ref), "left_anti"), "ladder")
        if edge.isEmpty():
            break
        known = known.unionByName(edge)
    rows = adds.unionByName(changes.join(known, changes.session_date.eqNullSafe(known.d) & (changes.ref == known.ref), "left_semi"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, out = LEVELS.split(", "), []
        book, day = Ladder(symbol), None
        close = lambda: out.extend((day, *k, *v) for k, v in book.levels.items())
        for b in batches:
            for d, *m in zip(*(b.column(c).to_pylist() for c in cols)):
                if d != day:
                    close()
                    book, day = Ladder(symbol), d
                book.step(*m)
        close()
        types = [pa.date32(), pa.string(), pa.int64(), pa.int64(), pa.int32()]
        data = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(data, types)], names=[n.split()[0] for n in names])

    return rows.repartition("session_date").sortWithinPartitions("session_date", "seq").select(*cols).mapInArrow(run, LEVELS)
