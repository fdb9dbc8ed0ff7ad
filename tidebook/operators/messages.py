"""From frames to typed messages and back.

Frames are rows of ``seq``, ``message_type`` and ``body``; ``seq`` is the place in the feed and the
only order that counts. Decoding is a projection, so fields that nobody asks for are not decoded.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import wire
from tidebook.functions.layout import DEFAULT, Field, MessageType, Venue
from tidebook.functions.scalars import price, split_timestamp, time_text
from tidebook.functions.text import trim_fixed
from tidebook.sources.decode import Chunk, field_places, field_type


def parse_types(spec: str) -> list[str]:
    """"A,E" or "AEP" to codes; commas are ignored."""
    return [c for c in spec if c not in ", "]


def filter_types(frames: DataFrame, codes: Iterable[str]) -> DataFrame:
    """Frames of the given types; none for an empty list. The filter reaches the source."""
    wanted = list(dict.fromkeys(codes))
    return frames.where(F.col("message_type").isin(*wanted)) if wanted else frames.limit(0)


def _others(frames: DataFrame) -> list[str]:
    return [c for c in frames.columns if c not in ("message_type", "body", "stock_locate", "tracking_number", "ts_ns")]


def decode(frames: DataFrame, code: str, venue: Venue = DEFAULT) -> DataFrame:
    """The messages of one type with all its fields, prices raw; other frame columns stay."""
    t = venue.types[code]
    rows = frames.where(F.col("message_type") == code)
    return rows.select(*_others(frames), "message_type", *[F.expr(f"{wire.read_sql(f)} AS `{f.name}`") for f in t.fields[1:]])


def _by_name(venue: Venue) -> dict[str, list[tuple[str, Field]]]:
    names: dict[str, list[tuple[str, Field]]] = {}
    for t in venue.types.values():
        for f in t.body:
            names.setdefault(f.name, []).append((t.code, f))
    return names


def wide(frames: DataFrame, venue: Venue = DEFAULT) -> DataFrame:
    """All messages in one table: header, then every field of any type, null where a type lacks it."""
    cols = []
    for name, places in _by_name(venue).items():
        same: dict[str, list[str]] = {}
        for c, f in places:
            same.setdefault(wire.read_sql(f), []).append(c)
        kind = "STRING" if places[0][1].kind == "a" else "BIGINT"
        whens = " ".join(f"WHEN message_type IN ({', '.join(repr(c) for c in codes)}) THEN CAST({sql} AS {kind})" for sql, codes in same.items())
        cols.append(F.expr(f"CASE {whens} END AS `{name}`"))
    head = next(iter(venue.types.values())).fields[1:4]
    return frames.select(*_others(frames), "message_type", *[F.expr(f"{wire.read_sql(f)} AS `{f.name}`") for f in head], *cols)


def unpack(frames: DataFrame, fields: Sequence[str] | None = None, venue: Venue = DEFAULT) -> DataFrame:
    """``wide`` for the named fields (all without names), by NumPy over Arrow batches: many times as fast
    where many fields are wanted. Only what is named is decoded, as Catalyst cannot prune it."""
    every = field_places(venue)
    chosen = {n: every[n] for n in (every if fields is None else fields)}
    others = _others(frames)
    types = dict(frames.dtypes)
    schema = [*(f"`{c}` {types[c]}" for c in [*others, "message_type"]), *(f"{n} {field_type(p)}" for n, p in chosen.items())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            chunk = Chunk.of_bodies(b.column("body"), b.column("message_type"))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in [*others, "message_type"]), *(chunk.field(p) for p in chosen.values())], names=[*others, "message_type", *chosen])

    return frames.select(*others, "message_type", "body").mapInArrow(run, ", ".join(schema))


def encode(rows: DataFrame, codes: Sequence[str] | None = None, venue: Venue = DEFAULT) -> DataFrame:
    """Typed rows to ``body``: the inverse of ``decode`` and ``wide``. Rows of other types, or with
    a null in a field of their type, get a null body. Timestamps are masked to 48 bits."""
    head_cols = set(rows.columns)
    whens = []
    for t in (venue.types[c] for c in (codes or venue.types)):
        missing = [f.name for f in t.fields if f.name not in head_cols]
        if missing:
            if codes:
                raise ValueError(f"{t.code}: missing columns {missing}")
            continue
        whens.append(f"WHEN message_type = '{t.code}' THEN concat({', '.join(wire.write_sql(f) for f in t.fields)})")
    return rows.withColumn("body", F.expr(f"CASE {' '.join(whens)} END") if whens else F.lit(None).cast("binary"))


def framed(body: Column) -> Column:
    """A body with its two-byte length before it, as it stands in a stream."""
    return F.concat(wire.put_uint(F.octet_length(body), 2), body)


def category(code: Column, venue: Venue = DEFAULT) -> Column:
    """add, modify, trade or other."""
    groups: dict[str, list[str]] = {}
    for t in venue.types.values():
        groups.setdefault(t.category, []).append(t.code)
    return reduce(lambda a, g: a.when(code.isin(groups[g]), g), [g for g in groups if g != "other"], F.when(F.lit(False), "")).otherwise("other")


def scaled(rows: DataFrame, venue: Venue = DEFAULT) -> DataFrame:
    """Typed rows with every price as DOUBLE in currency units."""
    decimals = {f.name: f.decimals for t in venue.types.values() for f in t.body if f.kind == "p"}
    return rows.select(*[price(F.col(c), decimals[c]).alias(c) if c in decimals else F.col(c) for c in rows.columns])


def with_timestamp_parts(rows: DataFrame) -> DataFrame:
    high, low = split_timestamp(F.col("ts_ns"))
    return rows.withColumn("ts_high", high).withColumn("ts_low", low)


def histogram(frames: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Messages per type, what has none under null, and in a row of type TOTAL all: one partial
    aggregation."""
    if by:
        return frames.groupBy(*by, "message_type").agg(F.count(F.lit(1)).alias("n"))
    out = frames.rollup("message_type").agg(F.count(F.lit(1)).alias("n"), F.grouping("message_type").alias("__all"))
    return out.select(F.when(F.col("__all") == 1, "TOTAL").otherwise(F.col("message_type")).alias("message_type"), "n")


def until_end(frames: DataFrame) -> DataFrame:
    """Frames up to and with the first system event C, all of them without one."""
    event = frames.where((F.col("message_type") == "S") & (wire.text(F.col("body"), 11, 1) == "C"))
    last = event.agg(F.min("seq").alias("__end")).first()["__end"]
    return frames if last is None else frames.where(F.col("seq") <= last)


# The text shown for a message; %name is a field, raw prices shown in currency units.
_TEXTS = """
S|System Event:|Event Code: %event_code
R|Stock Directory:|Stock: %stock
H|Stock Trading Action:|Stock: %stock|State: %trading_state
Y|Reg SHO Message:|Stock: %stock
L|Market Participant Position:|MPID: %mpid|Stock: %stock
V|MWCB Decline Level:|Level 1: %level1
W|MWCB Status:|Level: %breached_level
K|IPO Quoting Period Update:|Stock: %stock
J|LULD Auction Collar:|Stock: %stock
h|Operational Halt:|Stock: %stock
A|Add Order:|Stock: %stock|Side: %buy_sell_indicator|Shares: %shares|Price: %price
F|Add Order (MPID):|Stock: %stock|MPID: %attribution|Side: %buy_sell_indicator|Shares: %shares|Price: %price
E|Order Executed:|Ref#: %order_reference_number|Shares: %executed_shares
C|Order Executed w/ Price:|Ref#: %order_reference_number|Price: %execution_price
X|Order Cancel:|Ref#: %order_reference_number|Cancelled Shares: %cancelled_shares
D|Order Delete:|Ref#: %order_reference_number
U|Order Replace:|Original Ref#: %original_order_reference_number|New Ref#: %new_order_reference_number|Shares: %shares|Price: %price
P|Non-Cross Trade:|Stock: %stock|Side: %buy_sell_indicator|Shares: %shares|Price: %price
Q|Cross Trade:|Stock: %stock|Shares: %shares|Cross Price: %cross_price|Match#: %match_number|Cross Type: %cross_type
B|Broken Trade:|Match#: %match_number
I|NOII Message:|Stock: %stock|Paired Shares: %paired_shares|Imbalance Shares: %imbalance_shares|Imbalance Direction: %imbalance_direction|Far Price: %far_price|Near Price: %near_price|Reference Price: %current_reference_price|Cross Type: %cross_type|Price Variation Indicator: %price_variation_indicator
N|RPII Message:|Stock: %stock
O|DLCR Message:|Stock: %stock
"""


def short_double(c: Column) -> Column:
    """Six significant digits without trailing zeros, as C's %g gives them, except that a value whose
    shortest decimal form is just half way rounds up."""
    x = c.cast("double")
    e = F.floor(F.log10(F.abs(x)) + F.lit(1e-12))
    tidy = lambda t: F.regexp_replace(t, r"\.?0+$", "")
    fixed = lambda n: F.format_string(f"%.{n}f", x)
    plain = F.when(e >= 5, fixed(0))
    for k in range(4, -5, -1):
        plain = plain.when(e == k, tidy(fixed(5 - k)))
    big = F.regexp_replace(F.format_string("%.5e", x), r"\.?0+e", "e")
    return F.when(x == 0, "0").when((e < -4) | (e >= 6), big).otherwise(plain)


def text_of(rows: DataFrame, venue: Venue = DEFAULT) -> Column:
    """What a person reads of a message, for rows with the columns of ``wide``."""
    out: Column | None = None
    for line in _TEXTS.strip().splitlines():
        code, title, *lines = line.split("|")
        fields = {f.name: f for f in venue.types[code].body}
        parts = [F.lit(title), F.concat(F.lit("  Timestamp: "), F.col("ts_ns").cast("string"))]
        usable = True
        for x in lines:
            label, _, name = x.partition("%")
            usable &= name in rows.columns
            if usable:
                f = fields[name]
                value = short_double(price(F.col(name), f.decimals)) if f.kind == "p" else trim_fixed(F.col(name)) if f.kind == "a" and f.size > 1 else F.col(name).cast("string")
                parts.append(F.concat(F.lit("  " + label), F.coalesce(value, F.lit(""))))
        if usable:
            cond = F.col("message_type") == code
            text = F.concat_ws("\n", *parts)
            out = F.when(cond, text) if out is None else out.when(cond, text)
    return out if out is not None else F.lit(None).cast("string")


def inspect(frames: DataFrame, limit: int = 20, venue: Venue = DEFAULT) -> DataFrame:
    """The first ``limit`` messages of the feed with their text."""
    first = wide(frames, venue).orderBy("seq").limit(limit)
    return first.select("seq", "message_type", time_text(F.col("ts_ns")).alias("time"), text_of(first, venue).alias("text"))


def create_message(spark: SparkSession, code: str, venue: Venue = DEFAULT, **values) -> DataFrame:
    """One typed row with its ``body``; fields left out are 0 or blank. An unknown type or field raises."""
    t: MessageType | None = venue.types.get(code)
    if t is None:
        raise ValueError(f"unknown message type {code!r}")
    unknown = set(values) - {f.name for f in t.fields}
    if unknown:
        raise ValueError(f"{code} has no fields {sorted(unknown)}")
    schema = ", ".join(f"{f.name} {'string' if f.kind == 'a' else 'int' if f.size == 2 else 'long'}" for f in t.fields)
    given = {"message_type": code} | values
    row = tuple(given.get(f.name, "" if f.kind == "a" else 0) & ((1 << 48) - 1) if f.name == "ts_ns" else given.get(f.name, "" if f.kind == "a" else 0) for f in t.fields)
    return encode(spark.createDataFrame([row], schema), [code], venue)
