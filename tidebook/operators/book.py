"""Order books, trades and top-of-book changes, rebuilt per instrument in feed order.

Trades, level changes and live orders come from the lives of single orders (see ``orders``). The top of
a book is a fold over all messages of one instrument: rows are shuffled once, by session date and
locate, and sorted by ``seq`` inside a partition; Arrow batches then stream through a function that holds
one instrument's book at a time, so memory follows the live orders, not the messages.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Collection, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.text import trim_fixed
from tidebook.operators import orders

IN = ["session_date", "stock_locate", "seq", "ts_ns", "message_type", "stock", "ref", "new_ref", "side", "shares", "price", "match_number", "printable", "cross_type"]
KEYS = "session_date date, stock_locate int, seq long, ts_ns long, "
BBO = KEYS + "has_bid boolean, bid_price long, bid_shares long, has_ask boolean, ask_price long, ask_shares long"
TRADES = KEYS + "symbol string, side string, shares long, price long, match_number long, printable boolean, is_cross boolean, cross_type string"
ORDERS = KEYS + "symbol string, order_reference_number long, side string, shares long, price long"
DELTAS = KEYS + "side string, price long, d_shares long, d_orders int"


class Book:
    """Live orders by reference and the levels they make up."""

    __slots__ = ("orders", "levels", "prices", "symbol", "shown")

    def __init__(self, symbol: str):
        self.orders: dict[int, list] = {}  # ref: [is_bid, shares, price, seq, ts]
        self.levels: tuple[dict, dict] = ({}, {})  # asks, bids: price to [shares, orders]
        self.prices: tuple[list, list] = ([], [])  # asks ascending, bids ascending by minus price
        self.symbol, self.shown = symbol, None

    def add(self, ref: int, bid: bool, shares: int, price: int, seq: int, ts: int) -> list:
        if ref in self.orders:
            return []
        self.orders[ref] = [bid, shares, price, seq, ts]
        level = self.levels[bid].get(price)
        if level is None:
            self.levels[bid][price] = [shares, 1]
            insort(self.prices[bid], -price if bid else price)
        else:
            level[0] += shares
            level[1] += 1
        return [(bid, price, shares, 1)]

    def reduce(self, ref: int, shares: int | None) -> list:
        """Take off ``shares``, all for None; an order with none left goes."""
        o = self.orders.get(ref)
        if o is None:
            return []
        bid, left, price = o[:3]
        gone = left if shares is None else min(shares, left)
        ends = gone == left  # so anything taken off an order of no shares ends it
        level = self.levels[bid][price]
        o[1] -= gone
        level[0] -= gone
        if ends:
            del self.orders[ref]
            level[1] -= 1
            if not level[1]:
                del self.levels[bid][price]
                ladder = self.prices[bid]
                del ladder[bisect_left(ladder, -price if bid else price)]
        return [(bid, price, -gone, -int(ends))] if gone or ends else []  # taking off 0 changes nothing

    def replace(self, ref: int, new: int, shares: int, price: int, seq: int, ts: int) -> list:
        o = self.orders.get(ref)
        if o is None:
            return []
        bid = o[0]
        return self.reduce(ref, None) + self.add(new, bid, shares, price, seq, ts)

    def best(self) -> tuple:
        out: tuple = ()
        for bid in (True, False):
            ladder = self.prices[bid]
            if ladder:
                price = -ladder[0] if bid else ladder[0]
                out += (True, price, self.levels[bid][price][0])
            else:
                out += (False, 0, 0)
        return out


EMPTY = (False, 0, 0, False, 0, 0)


def book_rows(messages: DataFrame) -> DataFrame:
    """Wide messages to the columns a book reads. Absent columns are null; without ``session_date``
    the whole feed is one session."""
    have = set(messages.columns)
    col = lambda n, t="long": F.col(n).cast(t) if n in have else F.lit(None).cast(t)
    u = F.col("message_type") == "U"
    rows = messages.where(F.col("message_type").isin(*"AFECXDUPQR"))
    return rows.select(
        col("session_date", "date").alias("session_date"), col("stock_locate", "int").alias("stock_locate"), col("seq").alias("seq"), col("ts_ns").alias("ts_ns"), "message_type",
        trim_fixed(col("stock", "string")).alias("stock"), F.when(u, col("original_order_reference_number")).otherwise(col("order_reference_number")).alias("ref"), col("new_order_reference_number").alias("new_ref"),
        col("buy_sell_indicator", "string").alias("side"), F.coalesce(*[col(c) for c in ("shares", "executed_shares", "cancelled_shares")]).alias("shares"),
        F.coalesce(*[col(c) for c in ("price", "execution_price", "cross_price")]).alias("price"), col("match_number").alias("match_number"), col("printable", "string").alias("printable"), col("cross_type", "string").alias("cross_type"),
    )


class Fold:
    """The state of one instrument and what a message makes of it; shared by batch and streaming."""

    def __init__(self, universe: Collection[str] | None = None):
        self.universe = frozenset(universe) if universe else None
        self.reset()

    def reset(self) -> None:
        self.book: Book | None = None
        self.directory: str | None = None

    def symbol(self) -> str:
        return (self.book.symbol if self.book else None) or self.directory or ""

    def step(self, m: tuple) -> tuple[list, list, list]:
        """(top-of-book rows, trade rows, level deltas) of one message, without the key columns."""
        _, _, seq, ts, t, stock, ref, new, side, shares, price, match, printable, cross = m
        trades: list = []
        if t == "R":
            self.directory = stock
            return [], [], []
        if t == "P":
            return [], [(stock or "", side, shares, price, match, True, False, None)], []
        if t == "Q":
            return [], [(stock or "", None, shares, price, match, True, True, cross)], []
        if self.book is None:
            if t not in "AF" or (self.universe is not None and stock not in self.universe):
                return [], [], []
            self.book = Book(stock or "")
        b = self.book
        if t in "AF":
            moved = b.add(ref, side == "B", shares or 0, price or 0, seq, ts)
        elif t in "EC":
            o = b.orders.get(ref)
            if t == "E" and o:
                trades.append((self.symbol(), "B" if o[0] else "S", shares, o[2], match, True, False, None))
            elif t == "C":
                trades.append((self.symbol(), ("B" if o[0] else "S") if o else None, shares, price, match, printable == "Y", False, None))
            moved = b.reduce(ref, shares or 0)
        elif t == "X":
            moved = b.reduce(ref, shares or 0)
        elif t == "D":
            moved = b.reduce(ref, None)
        else:
            moved = b.replace(ref, new, shares or 0, price or 0, seq, ts)
        tops: list = []
        if moved:
            now = b.best()
            if now != (b.shown or EMPTY):
                b.shown = now
                tops.append(now)
        return tops, trades, moved


_ARROW = {"date": pa.date32(), "int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_BBO = pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in BBO.split(", "))])


def _tops(universe: frozenset | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, key, out = Fold(universe), None, []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out)) if out else [[] for _ in _BBO]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _BBO)], schema=_BBO)

        for batch in batches:
            for m in zip(*(c.to_pylist() for c in batch.columns)):
                if m[:2] != key:
                    fold.reset()
                    key = m[:2]
                out.extend((*m[:4], *r) for r in fold.step(m)[0])
            if len(out) > 20_000:
                yield flush()
        yield flush()

    return run


def rebuild(messages: DataFrame, kind: str, universe: Collection[str] | None = None) -> DataFrame:
    """``kind`` bbo: every change of the top of a book; trades: the tape; orders: what is live at the
    end; deltas: every change of a level's shares and orders. Prices are raw.

    A book begins at its locate's first A or F of a symbol in ``universe`` (none: all); what comes
    before is ignored, as are references that are not live in that locate's book. P and Q make trades
    whatever the universe. Messages with a null seq have no place and are left out, changes of an order
    that name none are ignored, and null locates form one instrument, as null dates do one session. A
    sequence number is one message's within its session and instrument."""
    rows = book_rows(messages).where("seq IS NOT NULL")
    if kind == "bbo":
        by_book = rows.repartition("session_date", "stock_locate").sortWithinPartitions("session_date", "stock_locate", "seq")
        return by_book.mapInArrow(_tops(frozenset(universe) if universe else None), BBO)
    return {"trades": orders.tape, "orders": orders.live_orders, "deltas": orders.deltas}[kind](rows, universe)


def levels(orders: DataFrame, max_levels: int = 0) -> DataFrame:
    """L2 depth of live orders: shares and orders per level, ``level`` from 1 at the best; levels of
    no shares count while they have orders. ``max_levels`` 0 gives all."""
    keys = ["session_date", "stock_locate", "side"]
    rows = orders.groupBy(*keys, "price").agg(F.sum("shares").alias("shares"), F.count(F.lit(1)).alias("order_count"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.when(F.col("side") == "B", -F.col("price")).otherwise(F.col("price"))))
    out = rows.withColumn("level", rank)
    return out.where(F.col("level") <= max_levels) if max_levels else out


def queue(orders: DataFrame) -> DataFrame:
    """L3: each live order's place in its level, first come first."""
    return orders.withColumn("position", F.row_number().over(Window.partitionBy("session_date", "stock_locate", "side", "price").orderBy("seq", "order_reference_number")))


def tops(orders: DataFrame) -> DataFrame:
    """The top of each book that has live orders."""
    bid, ask = F.col("side") == "B", F.col("side") == "S"
    best = orders.groupBy("session_date", "stock_locate", "side", "price").agg(F.sum("shares").alias("s"))
    key = F.when(bid, -F.col("price")).otherwise(F.col("price"))
    g = best.groupBy("session_date", "stock_locate").agg(F.min_by(F.struct("price", "s"), F.when(bid, key)).alias("b"), F.min_by(F.struct("price", "s"), F.when(ask, key)).alias("a"))
    zero = F.lit(0).cast("long")
    return g.select("session_date", "stock_locate", F.col("b").isNotNull().alias("has_bid"), F.coalesce("b.price", zero).alias("bid_price"), F.coalesce("b.s", zero).alias("bid_shares"), F.col("a").isNotNull().alias("has_ask"), F.coalesce("a.price", zero).alias("ask_price"), F.coalesce("a.s", zero).alias("ask_shares"))


def book_index(messages: DataFrame, universe: Collection[str] | None = None) -> DataFrame:
    """One row per book: its locate and symbol, that of its first add in the universe."""
    adds = book_rows(messages).where(F.col("message_type").isin("A", "F"))
    if universe:
        adds = adds.where(F.col("stock").isin(*universe))
    return adds.groupBy("session_date", "stock_locate").agg(F.min_by("stock", "seq").alias("symbol"), F.min("seq").alias("first_seq"))


def symbols(messages: DataFrame) -> DataFrame:
    """Symbol per locate: the book's own, else the directory's latest, else empty."""
    rows = book_rows(messages).where(F.col("message_type").isin("A", "F", "R"))
    add, named = F.col("message_type") != "R", F.col("message_type") == "R"
    g = rows.groupBy("session_date", "stock_locate").agg(F.min_by("stock", F.when(add, F.col("seq"))).alias("s"), F.max_by("stock", F.when(named, F.col("seq"))).alias("r"))
    return g.select("session_date", "stock_locate", F.coalesce(F.when(F.col("s") != "", F.col("s")), F.col("r"), F.lit("")).alias("symbol"))


def without_broken(trades: DataFrame, messages: DataFrame) -> DataFrame:
    """Opt-in: trades whose match number no broken-trade message of the day names."""
    broken = messages.where(F.col("message_type") == "B").select(F.col("session_date").alias("__d"), F.col("match_number").alias("__m")).distinct()
    return trades.join(broken, F.col("session_date").eqNullSafe(F.col("__d")) & (F.col("match_number") == F.col("__m")), "left_anti")


# The frame of a printed ladder.
_BORDER = "=" * 42
_RULE = "-----------+--------------+--------------"


def ladder_text(depth: DataFrame) -> DataFrame:
    """Levels as lines: asks from high to low, a rule, bids from high to low, in a frame. Columns
    ``session_date``, ``stock_locate``, ``line_no``, ``line``."""
    bid = F.col("side") == "B"
    line = F.format_string("%10d | %12.4f | %s", F.col("shares"), F.col("price") / F.lit(10000.0), F.when(bid, "Bid").otherwise("Ask"))
    book = ["session_date", "stock_locate"]
    rows = depth.select(*book, F.when(bid, 4).otherwise(2).alias("part"), (-F.col("price")).alias("k"), line.alias("line"))
    frame = F.array(*[F.struct(F.lit(p).alias("part"), F.lit(k).cast("long").alias("k"), F.lit(t).alias("line")) for p, k, t in [(1, 0, _BORDER), (1, 1, "   SHARES  |    PRICE     | SIDE "), (1, 2, _BORDER), (3, 0, _RULE), (5, 0, _BORDER)]])
    fixed = rows.select(*book).distinct().select(*book, F.explode(frame).alias("f")).select(*book, "f.*")
    number = F.row_number().over(Window.partitionBy(*book).orderBy("part", "k"))
    return rows.unionByName(fixed).select(*book, number.alias("line_no"), "line")
