"""Bars, averages and microstructure over trades and tops of book.

Prices come raw (4 implied decimals) and sums are exact; a division makes the double at the end.
What is undefined is null, not NaN. ``by`` names what a builder runs over, an instrument unless the
caller wants the whole market as one; an empty list does that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.scalars import price
from tidebook.operators.carry import carry_max
from tidebook.operators.ordered import order_block, prefix_sums, previous, runs

SCALE = 10_000.0
BLOCK = 1 << 20


def _ratio(num: Column, den: Column) -> Column:
    return F.when(den != 0, num.cast("double") / den.cast("double"))


def _notional() -> Column:
    return F.col("price").cast("decimal(20,0)") * F.col("shares").cast("decimal(18,0)")


def vwap_of(notional: Column, volume: Column) -> Column:
    return F.when(volume != 0, notional.cast("double") / (volume.cast("double") * F.lit(SCALE)))


# bars ------------------------------------------------------------------------------------------

def with_time_bucket(trades: DataFrame, interval_ns: int) -> DataFrame:
    return trades.withColumn("bucket", F.expr(f"ts_ns div {int(interval_ns)}L"))


def with_tick_bucket(trades: DataFrame, n: int, by: Sequence[str], block: int = BLOCK) -> DataFrame:
    """The trade's index within ``by``, from 0, divided by ``n``."""
    counted = prefix_sums(trades, by, ["seq"], {"__i": F.lit(1)}, order_block("seq", block), inclusive=False)
    return counted.withColumn("bucket", F.expr(f"__i div {int(n)}L")).drop("__i")


def with_volume_bucket(trades: DataFrame, volume: int, by: Sequence[str], block: int = BLOCK) -> DataFrame:
    """The volume before this trade divided by ``volume``."""
    summed = prefix_sums(trades, by, ["seq"], {"__v": F.col("shares")}, order_block("seq", block), inclusive=False)
    return summed.withColumn("bucket", F.expr(f"cast(__v as bigint) div {int(volume)}L")).drop("__v")


def bars(bucketed: DataFrame, by: Sequence[str], block: int = BLOCK) -> DataFrame:
    """A bar per run of one ``bucket`` in feed order: a bucket met again is another bar, empty buckets
    give none, the last bar may be partial. Raw open, high, low, close; volume, trades, vwap.
    ``printable`` is the caller's affair. ``seq`` must be total within ``by``."""
    p = F.col("price")
    aggs = [("open", "first", p), ("high", "max", p), ("low", "min", p), ("close", "last", p), ("volume", "sum", F.col("shares")), ("n_trades", "count", F.lit(1)), ("__notional", "sum", _notional())]
    out = runs(bucketed, by, "seq", "bucket", aggs, order_block("seq", block))
    return out.withColumn("vwap", vwap_of(F.col("__notional"), F.col("volume"))).drop("__notional").withColumnRenamed("run", "bar")


# averages --------------------------------------------------------------------------------------

def vwap(trades: DataFrame, by: Sequence[str]) -> DataFrame:
    """vwap (null without volume) and volume."""
    g = trades.groupBy(*by).agg(F.sum(_notional()).alias("__n"), F.sum("shares").alias("volume"))
    return g.select(*by, vwap_of(F.col("__n"), F.col("volume")).alias("vwap"), "volume")


def vwap_running(trades: DataFrame, by: Sequence[str], block: int = BLOCK) -> DataFrame:
    """After each trade, the vwap of its key so far."""
    s = prefix_sums(trades, by, ["seq"], {"__n": _notional(), "volume": F.col("shares")}, order_block("seq", block))
    return s.withColumn("volume", F.col("volume").cast("long")).withColumn("vwap", vwap_of(F.col("__n"), F.col("volume"))).drop("__n")


def twap(trades: DataFrame, by: Sequence[str], block: int = BLOCK) -> DataFrame:
    """Each price weighted by the time it stood; time that does not advance adds nothing but replaces
    price and time. Without any elapsed time the last price."""
    rows = previous(trades, by, "seq", ["ts_ns", "price"], order_block("seq", block))
    dt = F.greatest(F.col("ts_ns") - F.col("prev.ts_ns"), F.lit(0))
    rows = rows.withColumn("__dt", F.coalesce(dt, F.lit(0))).withColumn("__w", F.coalesce(F.col("prev.price").cast("decimal(20,0)") * dt.cast("decimal(18,0)"), F.lit(0)))
    g = rows.groupBy(*by).agg(F.sum("__w").alias("__w"), F.sum("__dt").alias("elapsed_ns"), F.max_by("price", "seq").alias("__last"))
    value = F.when(F.col("elapsed_ns") > 0, F.col("__w").cast("double") / (F.col("elapsed_ns").cast("double") * F.lit(SCALE))).otherwise(price(F.col("__last")))
    return g.select(*by, value.alias("twap"), "elapsed_ns")


# top of book -----------------------------------------------------------------------------------

def spread() -> Column:
    return F.when(F.col("has_bid") & F.col("has_ask"), (F.col("ask_price") - F.col("bid_price")).cast("double") / F.lit(SCALE))


def mid_price() -> Column:
    return F.when(F.col("has_bid") & F.col("has_ask"), (F.col("ask_price") + F.col("bid_price")).cast("double") / F.lit(2 * SCALE))


def queue_imbalance() -> Column:
    return _ratio(F.col("bid_shares") - F.col("ask_shares"), F.col("bid_shares") + F.col("ask_shares"))


def order_flow_imbalance(tops: DataFrame, by: Sequence[str] = ("session_date", "stock_locate"), block: int = BLOCK) -> DataFrame:
    """Change of buying over selling interest from each key's previous top, null on its first. An
    absent side has price 0 and size 0."""
    side = ["bid_price", "bid_shares", "ask_price", "ask_shares"]
    rows = previous(tops, by, "seq", side, order_block("seq", block))
    b, pb, bs, pbs = F.col("bid_price"), F.col("prev.bid_price"), F.col("bid_shares"), F.col("prev.bid_shares")
    a, pa_, as_, pas = F.col("ask_price"), F.col("prev.ask_price"), F.col("ask_shares"), F.col("prev.ask_shares")
    bid = F.when(b > pb, bs).when(b == pb, bs - pbs).when(b < pb, -pbs)
    ask = F.when(a > pa_, pas).when(a == pa_, as_ - pas).when(a < pa_, -as_)
    return rows.withColumn("ofi", (bid - ask).cast("long")).drop("prev")


def depth_at(levels: DataFrame, n: int = 0) -> DataFrame:
    """Shares on the best ``n`` levels of each side; 0 takes all."""
    rows = levels.where(F.col("level") <= n) if n else levels
    return rows.groupBy("session_date", "stock_locate", "side").agg(F.sum("shares").alias("shares"))


# auctions --------------------------------------------------------------------------------------

NOII = ["paired_shares", "imbalance_shares", "imbalance_direction", "far_price", "near_price", "current_reference_price", "price_variation_indicator"]


def auctions(messages: DataFrame, by: Sequence[str] = ("session_date", "stock_locate"), block: int = BLOCK) -> DataFrame:
    """Each cross with the latest imbalance message of its instrument before it, whatever that one's
    cross type; nulls without one. A context serves any number of crosses."""
    cross = F.col("message_type") == "Q"
    rows = messages.where(F.col("message_type").isin("I", "Q")).select(*by, "seq", "ts_ns", cross.alias("__q"), "stock", "shares", "cross_price", "match_number", "cross_type", F.when(~cross, F.struct("seq", *NOII)).alias("noii"))
    seen = carry_max(rows, by, "seq", ["noii"], strict=True, block=order_block("seq", block))
    kept = [c for c in seen.columns if c not in ("__q", "noii")]
    return seen.where("__q").select(*kept, F.col("noii").isNotNull().alias("has_imbalance"), *[F.col(f"noii.{c}").alias(c) for c in NOII])


# transport -------------------------------------------------------------------------------------

def sequence_gaps(packets: DataFrame, session: str = "session", order: str = "packet", first: str = "first_seq", count: str = "msg_count", block: int = BLOCK) -> DataFrame:
    """``packets`` with ``expected`` (null where a session is first seen), ``missing`` messages before
    it and ``fresh`` messages not seen before. What is expected never steps back."""
    rows = packets.withColumn("__end", F.col(first) + F.col(count))
    seen = carry_max(rows.withColumn("expected", F.col("__end")), [session], order, ["expected"], strict=True, block=order_block(order, block))
    e = F.col("expected")
    missing = F.when(e.isNull(), 0).otherwise(F.greatest(F.col(first) - e, F.lit(0)))
    fresh = F.when(e.isNull(), F.col(count)).otherwise(F.greatest(F.lit(0), F.col("__end") - F.greatest(F.col(first), e)))
    return seen.select("*", missing.cast("long").alias("missing"), fresh.cast("long").alias("fresh")).drop("__end")


def sequence_summary(gaps: DataFrame, session: str = "session") -> DataFrame:
    """Per session what to expect next, messages seen and messages missed."""
    return gaps.groupBy(session).agg(F.max(F.greatest(F.coalesce("expected", F.lit(0)), F.col("first_seq") + F.col("msg_count"))).alias("expected_next"), F.sum("fresh").alias("messages_seen"), F.sum("missing").alias("gap_count"))


def imbalance_info(messages: DataFrame) -> DataFrame:
    """The imbalance messages by themselves, prices in currency units."""
    rows = messages.where(F.col("message_type") == "I")
    prices = ("far_price", "near_price", "current_reference_price")
    return rows.select("seq", "ts_ns", "stock_locate", "stock", "cross_type", *[price(F.col(c)).alias(c) if c in prices else F.col(c) for c in NOII])
