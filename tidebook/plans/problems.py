"""Queries of the record-pipeline operators (p1, p4, p5, p6, p7) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions.text import trim_fixed
from tidebook.operators.asof import attributes_at
from tidebook.operators.changefeed import last_values, open_entries
from tidebook.operators.frequencies import heavy_keys, key_profile, value_frequencies, weighted_percentiles
from tidebook.operators.references import missing_references, orphans_in_time
from tidebook.operators.seen import SeenBitmaps, increments
from tidebook.runtime import load, materialize, new_path

MIN_SHARE = 0.05
PROBS = (0.1, 0.5, 0.9, 0.99)


def session_key():
    return F.date_format("session_date", "yyyy-MM-dd")


def _locates(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "add_order").select("session_date", F.col("stock_locate").cast("string").alias("key_text"), "message_type", "shares", "price")


def _symbols(spark: SparkSession, d: str) -> DataFrame:
    text = trim_fixed("symbol")
    return load(spark, d, "export_row").select("session_date", F.when(F.trim(text) != "", text).alias("key_text"), "message_type", "shares", "price")


# 1 -------------------------------------------------------------------------------------------

def p1_found(spark: SparkSession, d: str) -> DataFrame:
    parts = []
    for name, rows in (("add_order", _locates(spark, d)), ("export_row", _symbols(spark, d))):
        freq = value_frequencies(rows, ["session_date", "key_text"], "message_type")
        parts.append(heavy_keys(freq, ["session_date"], "key_text", MIN_SHARE).select(F.lit(name).alias("src_table"), session_key().alias("session_key"), "key_text"))
    return parts[0].unionByName(parts[1])


def _profile(rows: DataFrame) -> DataFrame:
    freq = value_frequencies(rows, ["session_date", "key_text"], "shares")
    return key_profile(freq, ["session_date", "key_text"]).select(session_key().alias("session_key"), "key_text", "n_rows", "n_values", "n_distinct", "mode", "mode_rows")


def p1_locate_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(_locates(spark, d))


def p1_symbol_profile(spark: SparkSession, d: str) -> DataFrame:
    return _profile(_symbols(spark, d))


def p1_locate_percentiles(spark: SparkSession, d: str) -> DataFrame:
    freq = value_frequencies(_locates(spark, d), ["session_date", "key_text"], "price")
    return weighted_percentiles(freq, ["session_date", "key_text"], PROBS).select(session_key().alias("session_key"), "key_text", "p", "percentile")


_LOCATES = "SELECT session_date, CAST(stock_locate AS VARCHAR) AS key_text, shares, price FROM add_order"
_TRIM = "rtrim({0}, ' ' || chr(0))"
_SYMBOLS = f"SELECT session_date, CASE WHEN trim({_TRIM.format('symbol')}) <> '' THEN {_TRIM.format('symbol')} END AS key_text, shares, price FROM export_row"


def _profile_sql(rows: str) -> str:
    return f"""
    WITH r AS ({rows}),
    c AS (SELECT session_date, key_text, shares, count(*) AS n FROM r GROUP BY ALL),
    m AS (SELECT *, row_number() OVER (PARTITION BY session_date, key_text ORDER BY (shares IS NULL), n DESC, shares) AS k FROM c)
    SELECT strftime(session_date, '%Y-%m-%d') AS session_key, key_text, CAST(sum(n) AS BIGINT) AS n_rows,
      CAST(coalesce(sum(n) FILTER (WHERE shares IS NOT NULL), 0) AS BIGINT) AS n_values, count(shares) AS n_distinct,
      max(shares) FILTER (WHERE k = 1) AS mode, max(n) FILTER (WHERE k = 1 AND shares IS NOT NULL) AS mode_rows
    FROM m GROUP BY session_date, key_text"""


_FOUND_1 = " UNION ALL ".join(
    f"""SELECT '{name}' AS src_table, strftime(session_date, '%Y-%m-%d') AS session_key, key_text FROM (
      SELECT session_date, key_text, count(*) AS n, sum(count(*)) OVER (PARTITION BY session_date) AS total
      FROM ({rows}) WHERE key_text IS NOT NULL GROUP BY session_date, key_text) WHERE n * 20 >= total"""
    for name, rows in (("add_order", _LOCATES), ("export_row", _SYMBOLS))
)
_PERCENTILES_1 = f"""
    WITH r AS (SELECT session_date, key_text, price, row_number() OVER w AS k, count(*) OVER (PARTITION BY session_date, key_text) AS n
      FROM ({_LOCATES}) WHERE price IS NOT NULL WINDOW w AS (PARTITION BY session_date, key_text ORDER BY price))
    SELECT strftime(session_date, '%Y-%m-%d') AS session_key, key_text, p, min(price) AS percentile
    FROM r, (SELECT unnest([CAST(0.1 AS DOUBLE), 0.5, 0.9, 0.99]) AS p) WHERE k >= greatest(1, ceil(p * n)) GROUP BY session_date, key_text, p"""


# 4 -------------------------------------------------------------------------------------------

KEY = ["session_date", "stock_locate", "ref"]
SOURCES = ("order_executed", "order_change")


def _reference_rows(spark: SparkSession, d: str) -> DataFrame:
    """References, births and ends of orders, one row for each but U, whose new id is another."""
    add, change, execd = (load(spark, d, t) for t in ("add_order", "order_change", "order_executed"))
    none = F.lit(None).cast("long")
    is_u = F.col("message_type") == "U"
    base = ["session_date", "stock_locate"]
    born = add.select(*base, F.col("order_reference_number").alias("ref"), "seq", F.lit(False).alias("is_ref"), F.col("seq").alias("born"), none.alias("ended"), F.lit(-1).alias("src"), none.alias("row_id"))
    named = change.select(
        *base, F.when(is_u, F.col("original_order_reference_number")).otherwise(F.col("order_reference_number")).alias("ref"), "seq", F.lit(True).alias("is_ref"),
        none.alias("born"), F.when(F.col("message_type").isin("D", "U"), F.col("seq")).alias("ended"), F.lit(1).alias("src"), "row_id",
    )
    replaced = change.where(is_u).select(*base, F.col("new_order_reference_number").alias("ref"), "seq", F.lit(False).alias("is_ref"), F.col("seq").alias("born"), none.alias("ended"), F.lit(-1).alias("src"), none.alias("row_id"))
    used = execd.select(*base, F.col("order_reference_number").alias("ref"), "seq", F.lit(True).alias("is_ref"), none.alias("born"), none.alias("ended"), F.lit(0).alias("src"), "row_id")
    return born.unionAll(named).unionAll(replaced).unionAll(used)


def _src():
    return F.when(F.col("src") == 0, SOURCES[0]).otherwise(SOURCES[1]).alias("src_table")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return orphans_in_time(_reference_rows(spark, d), KEY, "seq", period=["session_date"]).select(_src(), session_key().alias("session_key"), "row_id")


def p4_by_period(spark: SparkSession, d: str) -> DataFrame:
    return p4_found(spark, d).groupBy("src_table", "session_key").agg(F.count(F.lit(1)).alias("n_orphans"))


def p4_never_added(spark: SparkSession, d: str) -> DataFrame:
    rows = _reference_rows(spark, d)
    refs = rows.where("is_ref AND ref IS NOT NULL")
    found = missing_references(refs.select("session_date", "stock_locate", "ref", "src", "row_id"), rows.where("born IS NOT NULL"), KEY, match="partial")
    return found.select(_src(), session_key().alias("session_key"), "row_id")


INSTRUMENT = ["session_date", "stock_locate", "stock"]


def p4_unknown_instruments(spark: SparkSession, d: str) -> DataFrame:
    """Trades that refer to an instrument by date, locate and stock, of which locate or stock may be
    null, and of which no order was added."""
    named = lambda t: load(spark, d, t).withColumn("stock", trim_fixed("stock"))
    trades = named("non_cross_trade").select(*INSTRUMENT, "trade_id")
    return missing_references(trades, named("add_order"), INSTRUMENT, match="partial")


_REFERENCES = """
    WITH refs AS (
      SELECT 'order_executed' AS src_table, session_date, stock_locate, order_reference_number AS ref, seq, row_id FROM order_executed
      UNION ALL SELECT 'order_change', session_date, stock_locate, CASE WHEN message_type = 'U' THEN original_order_reference_number ELSE order_reference_number END, seq, row_id FROM order_change),
    born AS (
      SELECT session_date, stock_locate, order_reference_number AS ref, seq FROM add_order
      UNION ALL SELECT session_date, stock_locate, new_order_reference_number, seq FROM order_change WHERE message_type = 'U'),
    ended AS (SELECT session_date, stock_locate, CASE WHEN message_type = 'U' THEN original_order_reference_number ELSE order_reference_number END AS ref, seq FROM order_change WHERE message_type IN ('D', 'U')),
    judged AS (
      SELECT r.src_table, r.session_date, r.row_id,
        (SELECT max(b.seq) FROM born b WHERE b.session_date = r.session_date AND b.stock_locate = r.stock_locate AND b.ref = r.ref AND b.seq < r.seq) AS b,
        (SELECT max(e.seq) FROM ended e WHERE e.session_date = r.session_date AND e.stock_locate = r.stock_locate AND e.ref = r.ref AND e.seq < r.seq) AS e
      FROM refs r WHERE r.ref IS NOT NULL)
"""
_FOUND_4 = _REFERENCES + "SELECT src_table, strftime(session_date, '%Y-%m-%d') AS session_key, row_id FROM judged WHERE b IS NULL OR e > b"
_NEVER_4 = _REFERENCES.replace(" AND b.seq < r.seq", "") + "SELECT src_table, strftime(session_date, '%Y-%m-%d') AS session_key, row_id FROM judged WHERE b IS NULL"


# 5 -------------------------------------------------------------------------------------------

#: Days of arrival an increment.
ARRIVALS = 3


def _deduplicated(spark: SparkSession, d: str) -> SeenBitmaps:
    """The store after the executions have come in, an increment for every ARRIVALS days in which they
    were received; those whose time is not known come last."""
    rows = load(spark, d, "order_executed")
    day = F.unix_date(F.to_date("received_at"))
    edge = rows.agg(F.min(day).alias("a"), F.max(day).alias("b"), F.count_if(day.isNull()).alias("n")).first()
    period = F.expr(f"(unix_date(to_date(received_at)) - {edge.a or 0}) div {ARRIVALS}")
    periods = [] if edge.a is None else [period == i for i in range((edge.b - edge.a) // ARRIVALS + 1)]
    if edge.n or not periods:
        periods.append(day.isNull())
    store = SeenBitmaps(spark, new_path(spark, "seen"))
    increments(store, rows, periods, trim_fixed("mold_session"), "match_number", ["received_at"], "row_id")
    return store


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _deduplicated(spark, d).dropped().select("row_id")


def p5_kept(spark: SparkSession, d: str) -> DataFrame:
    return _deduplicated(spark, d).kept()


def p5_seen(spark: SparkSession, d: str) -> DataFrame:
    return _deduplicated(spark, d).counts().select(F.col("space").alias("mold_session"), "n_seen")


_RANK_5 = f"""SELECT *, CASE WHEN mold_session IS NULL OR match_number IS NULL THEN 1 ELSE
    row_number() OVER (PARTITION BY {_TRIM.format('mold_session')}, match_number ORDER BY received_at, row_id) END AS k FROM order_executed"""


# 6 -------------------------------------------------------------------------------------------

_FEED_6 = """
    SELECT session_date AS period, seq, row_id, 2 AS kind, stock_locate AS part, order_reference_number AS id, CAST(NULL AS BIGINT) AS new_id, shares AS qty FROM {adds}
    UNION ALL
    SELECT session_date, seq, row_id, CASE message_type WHEN 'D' THEN 0 WHEN 'U' THEN 1 WHEN 'X' THEN 4 END, stock_locate,
      CASE WHEN message_type = 'U' THEN original_order_reference_number ELSE order_reference_number END, new_order_reference_number,
      CASE WHEN message_type = 'U' THEN shares ELSE cancelled_shares END FROM {changes}
"""


def _open_orders(spark: SparkSession, d: str):
    return open_entries(spark.sql(_FEED_6, adds=load(spark, d, "add_order"), changes=load(spark, d, "order_change")))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _open_orders(spark, d).entries.select(F.date_format("period", "yyyy-MM-dd").alias("session_key"), F.col("part").alias("stock_locate"), F.col("id").alias("order_reference_number"))


def p6_state(spark: SparkSession, d: str) -> DataFrame:
    """The open orders with the last value of each field among the changes since they were opened: price
    and shares are set by what opened them, the time by every change."""
    writes = spark.sql(
        """
        SELECT session_date AS period, stock_locate AS part, order_reference_number AS id, seq, true AS opens, price, shares, ts_ns, ts_ns AS last_ts_ns FROM {adds}
        UNION ALL SELECT session_date, stock_locate, order_reference_number, seq, false, NULL, NULL, NULL, ts_ns FROM {changes} WHERE message_type = 'X'
        UNION ALL SELECT session_date, stock_locate, new_order_reference_number, seq, true, price, shares, ts_ns, ts_ns FROM {changes} WHERE message_type = 'U'
        """,
        adds=load(spark, d, "add_order"),
        changes=load(spark, d, "order_change"),
    )
    entries = materialize(_open_orders(spark, d).entries, "open")
    # an insert or replacement that came while the order was open had no effect
    since = entries.select("period", "part", "id", "since")
    effective = writes.join(since, ["period", "part", "id"]).where("seq = since OR (seq > since AND NOT opens)")
    state = last_values(entries, effective, ["price", "shares", "ts_ns", "last_ts_ns"])
    return state.select(
        F.date_format("period", "yyyy-MM-dd").alias("session_key"), F.col("part").alias("stock_locate"), F.col("id").alias("order_reference_number"), "price",
        F.col("shares").alias("opened_shares"), F.col("left").alias("shares_left"), F.col("ts_ns").alias("opened_ts_ns"), "last_ts_ns",
    )


# one message after the other, an instrument's open orders as a map
_REPLAY_6 = """
WITH RECURSIVE raw AS (
  SELECT session_date, seq, row_id, 'A' AS t, stock_locate, order_reference_number AS ref, CAST(NULL AS BIGINT) AS new_ref, shares AS qty, price, ts_ns FROM add_order
  UNION ALL SELECT session_date, seq, row_id, message_type, stock_locate, CASE WHEN message_type = 'U' THEN original_order_reference_number ELSE order_reference_number END,
    new_order_reference_number, CASE WHEN message_type = 'X' THEN cancelled_shares ELSE shares END, price, ts_ns FROM order_change),
once AS (SELECT * FROM raw WHERE session_date IS NOT NULL AND seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_date, seq ORDER BY row_id) = 1),
m AS (SELECT *, row_number() OVER (PARTITION BY session_date, stock_locate ORDER BY seq) AS n FROM once WHERE stock_locate IS NOT NULL AND ref IS NOT NULL),
s AS (
  SELECT DISTINCT session_date, stock_locate, CAST(0 AS BIGINT) AS n, CAST(MAP {} AS MAP(BIGINT, STRUCT(qty BIGINT, size BIGINT, price BIGINT, ts BIGINT, last BIGINT))) AS book FROM m
  UNION ALL
  SELECT s.session_date, s.stock_locate, m.n, CASE
    WHEN t = 'A' THEN CASE WHEN map_contains(book, ref) THEN book ELSE map_concat(book, MAP {ref: {'qty': m.qty, 'size': m.qty, 'price': price, 'ts': ts_ns, 'last': ts_ns}}) END
    WHEN NOT map_contains(book, ref) THEN book
    WHEN t = 'X' AND coalesce(coalesce(m.qty, 0) < book[ref].qty, true)
      THEN map_concat(book, MAP {ref: {'qty': book[ref].qty - coalesce(m.qty, 0), 'size': book[ref].size, 'price': book[ref].price, 'ts': book[ref].ts, 'last': ts_ns}})
    WHEN t = 'U' AND new_ref IS NOT NULL AND (new_ref = ref OR NOT map_contains(book, new_ref))
      THEN map_concat(map_from_entries(list_filter(map_entries(book), lambda e: e.key <> ref)), MAP {new_ref: {'qty': m.qty, 'size': m.qty, 'price': price, 'ts': ts_ns, 'last': ts_ns}})
    ELSE map_from_entries(list_filter(map_entries(book), lambda e: e.key <> ref)) END
  FROM s JOIN m ON m.session_date = s.session_date AND m.stock_locate = s.stock_locate AND m.n = s.n + 1),
ends AS (SELECT session_date, stock_locate, unnest(map_entries(book)) AS e FROM s QUALIFY row_number() OVER (PARTITION BY session_date, stock_locate ORDER BY n DESC) = 1)
"""


# 7 -------------------------------------------------------------------------------------------

def _with_attributes(spark: SparkSession, d: str) -> DataFrame:
    trades = load(spark, d, "non_cross_trade").where("stock_locate IS NOT NULL").select("trade_id", "session_date", "stock_locate", "ts_ns").distinct()
    changes = {
        "action": load(spark, d, "stock_trading_action").where("trading_state IS NOT NULL").withColumn("payload", F.struct("msg_id", F.col("trading_state").alias("value"))),
        "sho": load(spark, d, "reg_sho").where("reg_sho_action IS NOT NULL").withColumn("payload", F.struct("msg_id", F.col("reg_sho_action").alias("value"))),
    }
    return attributes_at(trades, changes, ["session_date", "stock_locate"], "ts_ns", holds_from="ts_ns", known_from="known_ns", version=["seq"], payload="payload")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    both = F.array(F.struct(F.lit("H").alias("message_type"), F.col("action.payload.msg_id").alias("msg_id")), F.struct(F.lit("Y").alias("message_type"), F.col("sho.payload.msg_id").alias("msg_id")))
    rows = _with_attributes(spark, d).select("trade_id", F.explode(both).alias("m"))
    return rows.where("m.msg_id IS NOT NULL").select("m.message_type", "trade_id", "m.msg_id")


def p7_attributes(spark: SparkSession, d: str) -> DataFrame:
    return _with_attributes(spark, d).select("trade_id", F.col("action.payload.value").alias("trading_state"), F.col("sho.payload.value").alias("reg_sho_action"))


def _asof_sql(kind: str, table: str, col: str) -> str:
    return f"""SELECT '{kind}' AS message_type, trade_id, msg_id, value FROM (
      SELECT t.trade_id, c.msg_id, c.{col} AS value, row_number() OVER (PARTITION BY t.trade_id ORDER BY c.ts_ns DESC, c.seq DESC) AS k
      FROM (SELECT DISTINCT trade_id, session_date, stock_locate, ts_ns FROM non_cross_trade) t JOIN {table} c
        ON t.session_date = c.session_date AND t.stock_locate = c.stock_locate AND c.ts_ns <= t.ts_ns AND c.known_ns <= t.ts_ns AND c.{col} IS NOT NULL) WHERE k = 1"""


_ASOF_7 = _asof_sql("H", "stock_trading_action", "trading_state") + " UNION ALL " + _asof_sql("Y", "reg_sho", "reg_sho_action")

QUERIES = {f.__name__: f for f in (p1_found, p1_locate_profile, p1_symbol_profile, p1_locate_percentiles, p4_found, p4_by_period, p4_never_added, p4_unknown_instruments, p5_found, p5_kept, p5_seen, p6_found, p6_state, p7_found, p7_attributes)}

ORACLES = {
    "p1_found": _FOUND_1,
    "p1_locate_profile": _profile_sql(_LOCATES),
    "p1_symbol_profile": _profile_sql(_SYMBOLS),
    "p1_locate_percentiles": _PERCENTILES_1,
    "p4_found": _FOUND_4,
    "p4_by_period": f"SELECT src_table, session_key, count(*) AS n_orphans FROM ({_FOUND_4}) GROUP BY ALL",
    "p4_never_added": _NEVER_4,
    "p4_unknown_instruments": f"""SELECT session_date, stock_locate, {_TRIM.format('stock')} AS stock, trade_id FROM non_cross_trade t
      WHERE NOT (session_date IS NULL AND stock_locate IS NULL AND stock IS NULL) AND NOT EXISTS (SELECT 1 FROM add_order a WHERE (t.session_date IS NULL OR t.session_date = a.session_date)
        AND (t.stock_locate IS NULL OR t.stock_locate = a.stock_locate) AND (t.stock IS NULL OR {_TRIM.format('t.stock')} = {_TRIM.format('a.stock')}))""",
    "p5_found": f"SELECT row_id FROM ({_RANK_5}) WHERE k > 1",
    "p5_kept": f"SELECT * EXCLUDE (k) FROM ({_RANK_5}) WHERE k = 1",
    "p5_seen": f"SELECT {_TRIM.format('mold_session')} AS mold_session, count(DISTINCT match_number) AS n_seen FROM order_executed WHERE mold_session IS NOT NULL AND match_number IS NOT NULL GROUP BY ALL",
    "p6_found": _REPLAY_6 + "SELECT strftime(session_date, '%Y-%m-%d') AS session_key, stock_locate, e.key AS order_reference_number FROM ends",
    "p6_state": _REPLAY_6 + """SELECT strftime(session_date, '%Y-%m-%d') AS session_key, stock_locate, e.key AS order_reference_number, e.value.price AS price, e.value.size AS opened_shares,
      e.value.qty AS shares_left, e.value.ts AS opened_ts_ns, e.value.last AS last_ts_ns FROM ends""",
    "p7_found": f"SELECT message_type, trade_id, msg_id FROM ({_ASOF_7})",
    "p7_attributes": f"""SELECT t.trade_id, max(value) FILTER (WHERE message_type = 'H') AS trading_state, max(value) FILTER (WHERE message_type = 'Y') AS reg_sho_action
      FROM (SELECT DISTINCT trade_id FROM non_cross_trade WHERE stock_locate IS NOT NULL) t LEFT JOIN ({_ASOF_7}) a USING (trade_id) GROUP BY t.trade_id""",
}
