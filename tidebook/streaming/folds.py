"""The keyed folds as Structured Streaming operators.

A fold keeps one state per key (an instrument of a day, a transport session) in the RocksDB state
store and takes a micro-batch's rows of the key in their order. Batches must arrive in feed order,
as the sources here deliver them; inside a batch rows are sorted. A stream gives the rows that the
batch operators give, except that a bar comes out only when the next one begins.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Collection, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

from tidebook.operators.book import BBO, DELTAS, IN, TRADES, Book, Fold, book_rows


class _Keyed(StatefulProcessor):
    """Holds ``make()`` per key as bytes; ``step(state, rows)`` changes it and gives output rows."""

    def __init__(self, make: Callable, step: Callable, order: str, columns: Sequence[str]):
        self.make, self.fold, self.order, self.columns = make, step, order, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", StructType([StructField("data", BinaryType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else self.make()
        batch = pd.concat(list(rows), ignore_index=True).sort_values(self.order, kind="stable")
        out = self.fold(held, key, _rows(batch))
        self.state.update((pickle.dumps(held),))
        if out:
            yield pd.DataFrame(out, columns=self.columns)

    def close(self) -> None:
        pass


def _rows(batch: pd.DataFrame) -> list[dict]:
    """Plain values, missing ones as None."""
    clean = batch.astype(object).where(batch.notna(), None)
    return clean.to_dict("records")


def _names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]


def _whole(x):
    return None if x is None else int(x)


def _run(df: DataFrame, keys: Sequence[str], order: str, ddl: str, make: Callable, step: Callable) -> DataFrame:
    return df.groupBy(*keys).transformWithStateInPandas(_Keyed(make, step, order, _names(ddl)), outputStructType=ddl, outputMode="Append", timeMode="None")


# books -----------------------------------------------------------------------------------------

class _State:
    """A fold that pickles: the book's slots are plain containers."""

    def __init__(self, universe):
        self.fold = Fold(universe)

    def __getstate__(self):
        b = self.fold.book
        return (self.fold.universe, self.fold.directory, None if b is None else (b.symbol, b.shown, b.orders, b.levels, b.prices))

    def __setstate__(self, s):
        self.fold = Fold(s[0])
        self.fold.directory = s[1]
        if s[2] is not None:
            b = self.fold.book = Book(s[2][0])
            b.shown, b.orders, b.levels, b.prices = s[2][1:]


def _book_step(kind: str):
    numbers = {"stock_locate", "seq", "ts_ns", "ref", "new_ref", "shares", "price", "match_number"}

    def step(state: _State, key, rows: list[dict]) -> list[tuple]:
        out = []
        for r in rows:
            m = tuple(_whole(r[c]) if c in numbers else r[c] for c in IN)
            tops, trades, moved = state.fold.step(m)
            if kind == "bbo":
                out += [(*m[:4], *t) for t in tops]
            elif kind == "trades":
                out += [(*m[:4], *t) for t in trades]
            else:
                out += [(*m[:4], "B" if bid else "S", p, ds, dn) for bid, p, ds, dn in moved]
        return out

    return step


def stream_books(messages: DataFrame, kind: str, universe: Collection[str] | None = None) -> DataFrame:
    """``rebuild`` over a stream of wide messages: ``kind`` bbo, trades or deltas."""
    ddl = {"bbo": BBO, "trades": TRADES, "deltas": DELTAS}[kind]
    chosen = frozenset(universe) if universe else None
    return _run(book_rows(messages).where("seq IS NOT NULL"), ["session_date", "stock_locate"], "seq", ddl, lambda: _State(chosen), _book_step(kind))


# bars ------------------------------------------------------------------------------------------

BARS = "session_date date, stock_locate int, bar long, bucket long, open long, high long, low long, close long, volume long, n_trades long"


def _bar_step(clock: str, size: int):
    def step(state: dict, key, rows: list[dict]) -> list[tuple]:
        out = []
        for r in rows:
            price, shares = int(r["price"]), int(r["shares"])
            bucket = int(r["ts_ns"]) // size if clock == "time" else state["n"] // size if clock == "tick" else state["v"] // size
            if state["bar"] is not None and state["bucket"] != bucket:
                out.append((*key, state["k"], state["bucket"], *state["bar"]))
                state["bar"], state["k"] = None, state["k"] + 1
            b = state["bar"]
            state["bar"] = [price, price, price, price, shares, 1] if b is None else [b[0], max(b[1], price), min(b[2], price), price, b[4] + shares, b[5] + 1]
            state["bucket"] = bucket
            state["n"] += 1
            state["v"] += shares
        return out

    return step


def stream_bars(trades: DataFrame, clock: str, size: int) -> DataFrame:
    """Finished bars per session date and locate; ``clock`` time (ns), tick (trades) or volume (shares)."""
    rows = trades.select("session_date", "stock_locate", "seq", "ts_ns", "price", "shares")
    return _run(rows, ["session_date", "stock_locate"], "seq", BARS, lambda: {"bar": None, "bucket": 0, "k": 0, "n": 0, "v": 0}, _bar_step(clock, size))


# transport -------------------------------------------------------------------------------------

GAPS = "session string, packet long, first_seq long, msg_count long, expected long, missing long, fresh long"


def _gap_step(state: dict, key, rows: list[dict]) -> list[tuple]:
    out = []
    for r in rows:
        first, count, e = int(r["first_seq"]), int(r["msg_count"]), state["expected"]
        end = first + count
        fresh = count if e is None else max(0, end - max(first, e))
        out.append((key[0], int(r["packet"]), first, count, e, 0 if e is None else max(first - e, 0), fresh))
        state["expected"] = end if e is None else max(e, end)
    return out


def stream_gaps(packets: DataFrame) -> DataFrame:
    """``sequence_gaps`` over a stream of packets."""
    return _run(packets.select("session", "packet", "first_seq", "msg_count"), ["session"], "packet", GAPS, lambda: {"expected": None}, _gap_step)


def request_missing(gaps: DataFrame, ask: Callable[[str, int, int], None], checkpoint: str):
    """A query that calls ``ask(session, first missing, how many)`` for every gap, in its batch."""

    def each(batch: DataFrame, _: int) -> None:
        for r in batch.where("missing > 0").select("session", "expected", "missing").toLocalIterator():
            ask(r.session, r.expected, r.missing)

    return gaps.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_within(frames: DataFrame, event_time: str, delay: str, keys: Sequence[str] = ("session", "packet_first", "seq")) -> DataFrame:
    """Opt-in: frames delivered again within ``delay`` are dropped."""
    return frames.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))
