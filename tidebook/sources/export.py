"""The flat table of 12 columns, for CSV and for Parquet, from wide messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.scalars import price, price_text
from tidebook.functions.text import trim_fixed

COLUMNS = ["message_type", "timestamp", "stock_locate", "tracking_number", "symbol", "reference_number", "side", "shares", "price", "match_number", "printable", "extra"]


def _of(types: str, c: Column) -> Column:
    return F.when(F.col("message_type").isin(*types), c)


def flat(messages: DataFrame, text: bool) -> DataFrame:
    """``text``: every column a string, blank where a type has no value, prices with 4 decimals and
    a category for R. Otherwise numbers are null where a type has none, texts blank, prices DOUBLE.
    Types other than SRAFECXDUPQ have their header only. U has its new reference."""
    have = set(messages.columns)
    col = lambda n: F.col(n) if n in have else F.lit(None)
    raw = F.coalesce(_of("AFUP", col("price").cast("long")), _of("C", col("execution_price").cast("long")), _of("Q", col("cross_price").cast("long")))
    ref = F.coalesce(_of("AFECXDP", col("order_reference_number")), _of("U", col("new_order_reference_number"))).cast("long")
    shares = F.coalesce(_of("AFUPQ", col("shares").cast("long")), _of("EC", col("executed_shares").cast("long")), _of("X", col("cancelled_shares").cast("long")))
    match = _of("ECPQ", col("match_number").cast("long"))
    extra = F.coalesce(
        _of("F", F.concat(F.lit("mpid="), trim_fixed(col("attribution").cast("string")))), _of("U", F.concat(F.lit("orig="), col("original_order_reference_number").cast("string"))),
        _of("Q", F.concat(F.lit("cross="), col("cross_type").cast("string"))), _of("S", F.concat(F.lit("event="), col("event_code").cast("string"))),
        *([_of("R", F.concat(F.lit("category="), col("market_category").cast("string")))] if text else []), F.lit(""),
    )
    blank = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    number = blank if text else (lambda c: c)
    return messages.select(
        "message_type", F.col("ts_ns").alias("timestamp"), "stock_locate", "tracking_number",
        blank(_of("AFPQR", trim_fixed(col("stock").cast("string")))).alias("symbol"), number(ref).alias("reference_number"), blank(_of("AFP", col("buy_sell_indicator"))).alias("side"),
        number(shares).alias("shares"), (blank(price_text(raw)) if text else price(raw)).alias("price"), number(match).alias("match_number"), blank(_of("C", col("printable"))).alias("printable"), extra.alias("extra"),
    )


def write_csv(messages: DataFrame, path: str, header: bool = True, mode: str = "errorifexists") -> None:
    """Fields are quoted only where they hold a comma or quote; blanks stay blank."""
    flat(messages, True).write.mode(mode).csv(path, header=header, emptyValue="", nullValue="", quoteAll=False, escape='"')


def write_parquet(messages: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat(messages, False).write.mode(mode).parquet(path)


def land(messages: DataFrame, path: str, mode: str = "append") -> None:
    """Decoded messages for repeated queries: partitioned by day, sorted for locate pruning, so that
    a query over one day or type reads only its part."""
    messages.repartition("session_date", "message_type").sortWithinPartitions("stock_locate", "seq").write.mode(mode).partitionBy("session_date", "message_type").parquet(path)
