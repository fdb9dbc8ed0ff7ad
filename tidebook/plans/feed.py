"""A deterministic order feed over the ``events`` table, in Spark and, identically, in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidebook.runtime import load

# {micros}, {qty} and {last} differ between the two dialects
_FEED = """
ev AS (
  SELECT event_id, event_id + 1 AS seq, CAST(user_id % 10 + 1 AS INT) AS stock_locate, CAST(ts AS DATE) AS session_date,
    ({micros} % 86400000000) * 1000 AS ts_ns, event_type,
    CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) + 1 AS qty, CAST(floor(value * 100 + 0.5) AS BIGINT) * 100 AS price_raw
  FROM events),
typed AS (
  SELECT *, CASE event_type
      WHEN 'view' THEN 'A' WHEN 'click' THEN CASE WHEN event_id % 4 = 0 THEN 'F' ELSE 'A' END
      WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'C' ELSE 'E' END
      WHEN 'error' THEN CASE event_id % 3 WHEN 0 THEN 'X' WHEN 1 THEN 'D' ELSE 'U' END
      WHEN 'signup' THEN CASE event_id % 5 WHEN 0 THEN 'P' WHEN 1 THEN 'Q' WHEN 4 THEN 'B' ELSE 'I' END END AS message_type,
    CASE event_id % 4 WHEN 0 THEN 'O' WHEN 1 THEN 'C' WHEN 2 THEN 'H' ELSE 'I' END AS cross_code
  FROM ev),
aimed AS (
  SELECT *, {last_add} AS target, {last_match} AS prior_match FROM typed),
feed AS (
  SELECT session_date, seq, message_type, stock_locate, CAST(0 AS INT) AS tracking_number, ts_ns,
    CASE WHEN message_type IN ('A', 'F', 'P', 'Q', 'I') THEN concat('SYM', CAST(stock_locate AS {text})) END AS stock,
    CASE WHEN message_type IN ('A', 'F') THEN seq WHEN message_type IN ('E', 'C', 'X', 'D') THEN coalesce(target, 0) WHEN message_type = 'P' THEN 0 END AS order_reference_number,
    CASE WHEN message_type = 'U' THEN coalesce(target, 0) END AS original_order_reference_number,
    CASE WHEN message_type = 'U' THEN seq END AS new_order_reference_number,
    CASE WHEN event_type = 'view' THEN 'B' WHEN event_type = 'click' THEN 'S' WHEN message_type = 'P' THEN CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'S' END END AS buy_sell_indicator,
    CASE WHEN message_type IN ('A', 'F', 'U', 'P', 'Q') THEN qty END AS shares,
    CASE WHEN message_type IN ('E', 'C') THEN qty END AS executed_shares, CASE WHEN message_type = 'X' THEN qty END AS cancelled_shares,
    CASE WHEN message_type IN ('A', 'F', 'U', 'P') THEN price_raw END AS price,
    CASE WHEN message_type = 'C' THEN price_raw END AS execution_price, CASE WHEN message_type = 'Q' THEN price_raw END AS cross_price,
    CASE WHEN message_type IN ('E', 'C', 'P', 'Q') THEN seq WHEN message_type = 'B' THEN coalesce(prior_match, 0) END AS match_number,
    CASE WHEN message_type = 'C' THEN CASE WHEN event_id % 8 = 0 THEN 'N' ELSE 'Y' END END AS printable,
    CASE WHEN message_type IN ('Q', 'I') THEN cross_code END AS cross_type,
    CASE WHEN message_type = 'F' THEN 'NSDQ' END AS attribution,
    CASE WHEN message_type = 'I' THEN qty * 10 END AS paired_shares, CASE WHEN message_type = 'I' THEN qty END AS imbalance_shares,
    CASE WHEN message_type = 'I' THEN CASE event_id % 3 WHEN 0 THEN 'B' WHEN 1 THEN 'S' ELSE 'Z' END END AS imbalance_direction,
    CASE WHEN message_type = 'I' THEN price_raw + 200 END AS far_price, CASE WHEN message_type = 'I' THEN price_raw + 100 END AS near_price,
    CASE WHEN message_type = 'I' THEN price_raw END AS current_reference_price, CASE WHEN message_type = 'I' THEN '1' END AS price_variation_indicator
  FROM aimed)
"""
_WINDOW = "OVER (PARTITION BY session_date, stock_locate ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
#: What a change aims at: mostly the last order added or named by a replacement, which may have failed, so
#: that chains of replacements occur; now and then the one before it is not followed any more.
_ADD, _MATCH = ("CASE WHEN message_type IN ('A', 'F', 'U') THEN seq END", "CASE WHEN message_type IN ('E', 'C', 'P', 'Q') THEN seq END")

#: For ``WITH``: the feed as a table ``feed`` in DuckDB.
SQL = _FEED.format(micros="epoch_us(ts)", text="VARCHAR", last_add=f"last_value({_ADD} IGNORE NULLS) {_WINDOW}", last_match=f"last_value({_MATCH} IGNORE NULLS) {_WINDOW}")
_SPARK = _FEED.format(micros="unix_micros(CAST(ts AS TIMESTAMP))", text="STRING", last_add=f"last_value({_ADD}) IGNORE NULLS {_WINDOW}", last_match=f"last_value({_MATCH}) IGNORE NULLS {_WINDOW}")


def messages(spark: SparkSession, d: str) -> DataFrame:
    """Wide messages; the columns are those of the types that occur."""
    return spark.sql("WITH " + _SPARK.replace("FROM events)", "FROM {events})") + " SELECT * FROM feed", events=load(spark, d, "events"))
