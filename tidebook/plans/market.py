"""The engine's own operators over the test feed, by name, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.functions import codes, scalars
from tidebook.functions.layout import DEFAULT
from tidebook.operators import analytics as an
from tidebook.operators import book as bk
from tidebook.operators import messages as ms
from tidebook.plans import feed
from tidebook.runtime import load
from tidebook.sources import export

MINUTE = 60_000_000_000
#: Blocks of the ordered operators, small enough that the test feed has several.
BLOCK = 4096
BY = ["session_date", "stock_locate"]
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return wrap


def _tape(spark: SparkSession, d: str) -> DataFrame:
    return bk.rebuild(feed.messages(spark, d), "trades")


# Books by replay: a step a message of each session and instrument, their live orders as a map. ``o`` is
# the order a message met, ``opens`` whether it opened one.
_BOOK = "WITH RECURSIVE " + feed.SQL.lstrip() + """,
begun AS (SELECT session_date, stock_locate, min(seq) AS start FROM feed WHERE message_type IN ('A', 'F') GROUP BY ALL),
acts AS (
  SELECT f.*, coalesce(original_order_reference_number, order_reference_number) AS ref, coalesce(executed_shares, cancelled_shares) AS want,
    row_number() OVER (PARTITION BY f.session_date, f.stock_locate ORDER BY seq) AS n
  FROM feed f JOIN begun b ON f.session_date = b.session_date AND f.stock_locate = b.stock_locate AND f.seq >= b.start WHERE message_type IN ('A', 'F', 'E', 'C', 'X', 'D', 'U')),
steps AS (
  SELECT session_date, stock_locate, CAST(0 AS BIGINT) AS n, CAST(MAP {} AS MAP(BIGINT, STRUCT(side VARCHAR, shares BIGINT, price BIGINT, born BIGINT))) AS book,
    CAST(NULL AS STRUCT(side VARCHAR, shares BIGINT, price BIGINT, born BIGINT)) AS o, false AS opens FROM begun
  UNION ALL
  SELECT s.session_date, s.stock_locate, a.n, CASE
      WHEN a.message_type IN ('A', 'F') THEN CASE WHEN map_contains(book, ref) THEN book ELSE map_concat(book, MAP {ref: {'side': buy_sell_indicator, 'shares': a.shares, 'price': a.price, 'born': seq}}) END
      WHEN NOT map_contains(book, ref) THEN book
      WHEN want < book[ref].shares THEN map_concat(book, MAP {ref: {'side': book[ref].side, 'shares': book[ref].shares - want, 'price': book[ref].price, 'born': book[ref].born}})
      WHEN a.message_type = 'U' AND NOT map_contains(book, new_order_reference_number)
        THEN map_concat(map_from_entries(list_filter(map_entries(book), lambda e: e.key <> ref)), MAP {new_order_reference_number: {'side': book[ref].side, 'shares': a.shares, 'price': a.price, 'born': seq}})
      ELSE map_from_entries(list_filter(map_entries(book), lambda e: e.key <> ref)) END,
    CASE WHEN map_contains(book, ref) THEN book[ref] END,
    CASE WHEN a.message_type = 'U' THEN map_contains(book, ref) AND NOT map_contains(book, new_order_reference_number) ELSE a.message_type IN ('A', 'F') AND NOT map_contains(book, ref) END
  FROM steps s JOIN acts a ON a.session_date = s.session_date AND a.stock_locate = s.stock_locate AND a.n = s.n + 1),
met AS (SELECT a.*, s.o, s.opens FROM acts a JOIN steps s ON a.session_date = s.session_date AND a.stock_locate = s.stock_locate AND a.n = s.n),
live AS (SELECT *, o.side AS side, o.price AS old_price, least(coalesce(want, o.shares), o.shares) AS took, coalesce(want, o.shares) >= o.shares AS ends FROM met WHERE o IS NOT NULL AND message_type NOT IN ('A', 'F')),
deltas AS (
  SELECT session_date, stock_locate, seq, coalesce(o.side, buy_sell_indicator) AS side, price, shares AS d_shares, 1 AS d_orders FROM met WHERE opens
  UNION ALL SELECT session_date, stock_locate, seq, side, old_price, -took, CASE WHEN ends THEN -1 ELSE 0 END FROM live),
orders AS (
  SELECT session_date, stock_locate, e.key AS ref, e.value.side AS side, e.value.price AS price, e.value.shares AS shares, e.value.born AS born
  FROM (SELECT session_date, stock_locate, unnest(map_entries(book)) AS e FROM steps QUALIFY row_number() OVER (PARTITION BY session_date, stock_locate ORDER BY n DESC) = 1)),
depth AS (
  SELECT session_date, stock_locate, side, price, CAST(sum(shares) AS BIGINT) AS shares, count(*) AS order_count,
    row_number() OVER (PARTITION BY session_date, stock_locate, side ORDER BY CASE WHEN side = 'B' THEN -price ELSE price END) AS level
  FROM orders GROUP BY session_date, stock_locate, side, price)
"""
_TAPE = _BOOK + """,
trades AS (
  SELECT f.session_date, f.seq, f.ts_ns, f.stock_locate, 'SYM' || f.stock_locate AS symbol, CASE WHEN f.message_type = 'P' THEN f.buy_sell_indicator ELSE l.side END AS side, coalesce(f.executed_shares, f.shares) AS shares,
    CASE f.message_type WHEN 'E' THEN l.old_price WHEN 'C' THEN f.execution_price WHEN 'P' THEN f.price ELSE f.cross_price END AS price, f.match_number,
    coalesce(f.printable = 'Y', true) AS printable, f.message_type = 'Q' AS is_cross, CASE WHEN f.message_type = 'Q' THEN f.cross_type END AS cross_type
  FROM feed f LEFT JOIN live l ON l.seq = f.seq LEFT JOIN begun b ON b.session_date = f.session_date AND b.stock_locate = f.stock_locate
  WHERE f.message_type IN ('P', 'Q') OR (f.message_type = 'E' AND l.seq IS NOT NULL) OR (f.message_type = 'C' AND f.seq > b.start))
"""


def _bars_sql(bucket: str, pre: str = "trades") -> str:
    return _TAPE + f""",
    b AS (SELECT *, {bucket} AS bucket FROM {pre}),
    n AS (SELECT *, CASE WHEN bucket IS DISTINCT FROM lag(bucket) OVER w OR row_number() OVER w = 1 THEN 1 ELSE 0 END AS fresh FROM b WINDOW w AS (PARTITION BY session_date, stock_locate ORDER BY seq)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY session_date, stock_locate ORDER BY seq) - 1 AS bar FROM n)
    SELECT session_date, stock_locate, CAST(bar AS BIGINT) AS bar, CAST(bucket AS BIGINT) AS bucket, min(seq) AS first_order, max(seq) AS last_order,
      arg_min(price, seq) AS open, max(price) AS high, min(price) AS low, arg_max(price, seq) AS close, CAST(sum(shares) AS BIGINT) AS volume, count(*) AS n_trades,
      CAST(sum(CAST(price AS HUGEINT) * shares) AS DOUBLE) / (CAST(sum(shares) AS DOUBLE) * 10000.0) AS vwap
    FROM r GROUP BY session_date, stock_locate, bar, bucket"""


# bars and averages -----------------------------------------------------------------------------

@query(_bars_sql(f"ts_ns // {MINUTE * 60}"))
def bars_time(spark, d):
    return an.bars(an.with_time_bucket(_tape(spark, d), 60 * MINUTE), BY, BLOCK)


@query(_bars_sql("(row_number() OVER (PARTITION BY session_date, stock_locate ORDER BY seq) - 1) // 5"))
def bars_tick(spark, d):
    return an.bars(an.with_tick_bucket(_tape(spark, d), 5, BY, BLOCK), BY, BLOCK)


@query(_bars_sql("CAST(sum(shares) OVER (PARTITION BY session_date, stock_locate ORDER BY seq) - shares AS BIGINT) // 500"))
def bars_volume(spark, d):
    return an.bars(an.with_volume_bucket(_tape(spark, d), 500, BY, BLOCK), BY, BLOCK)


_VWAP = "CAST(sum(CAST(price AS HUGEINT) * shares) {0} AS DOUBLE) / (CAST(sum(shares) {0} AS DOUBLE) * 10000.0)"


@query(_TAPE + f"SELECT session_date, stock_locate, CASE WHEN sum(shares) <> 0 THEN {_VWAP.format('')} END AS vwap, CAST(sum(shares) AS BIGINT) AS volume FROM trades GROUP BY session_date, stock_locate")
def vwap_session(spark, d):
    return an.vwap(_tape(spark, d), BY)


@query(_TAPE + f"SELECT session_date, stock_locate, seq, CAST(sum(shares) OVER w AS BIGINT) AS volume, {_VWAP.format('OVER w')} AS vwap FROM trades WINDOW w AS (PARTITION BY session_date, stock_locate ORDER BY seq)")
def vwap_running(spark, d):
    return an.vwap_running(_tape(spark, d), BY, BLOCK).select("session_date", "stock_locate", "seq", "volume", "vwap")


@query(_TAPE + f"SELECT session_date, stock_locate, ts_ns // {60 * MINUTE} AS bucket, {_VWAP.format('')} AS vwap, CAST(sum(shares) AS BIGINT) AS volume FROM trades GROUP BY ALL")
def vwap_interval(spark, d):
    return an.vwap(an.with_time_bucket(_tape(spark, d), 60 * MINUTE), [*BY, "bucket"])


@query(_TAPE + """,
    l AS (SELECT *, lag(price) OVER w AS pp, greatest(ts_ns - lag(ts_ns) OVER w, 0) AS dt FROM trades WINDOW w AS (PARTITION BY session_date, stock_locate ORDER BY seq)),
    g AS (SELECT session_date, stock_locate, coalesce(sum(CAST(pp AS HUGEINT) * dt), 0) AS w, CAST(coalesce(sum(dt), 0) AS BIGINT) AS elapsed_ns, arg_max(price, seq) AS last FROM l GROUP BY session_date, stock_locate)
    SELECT session_date, stock_locate, CASE WHEN elapsed_ns > 0 THEN CAST(CAST(w AS VARCHAR) AS DOUBLE) / (CAST(elapsed_ns AS DOUBLE) * 10000.0) ELSE CAST(last AS DOUBLE) / 10000.0 END AS twap, elapsed_ns FROM g""")
def twap(spark, d):
    return an.twap(_tape(spark, d), BY, BLOCK)


# messages --------------------------------------------------------------------------------------

_F = "WITH " + feed.SQL


@query(_F + "SELECT message_type, count(*) AS n FROM feed GROUP BY message_type UNION ALL SELECT 'TOTAL', count(*) FROM feed")
def type_histogram(spark, d):
    return ms.histogram(feed.messages(spark, d))


@query(_F + "SELECT seq, message_type, stock_locate FROM feed WHERE message_type IN ('A', 'P', 'E', 'C', 'X')")
def type_filter(spark, d):
    return ms.filter_types(feed.messages(spark, d), ms.parse_types("A,PECX")).select("seq", "message_type", "stock_locate")


@query(_F + "SELECT seq, message_type, stock_locate FROM feed WHERE false")
def type_filter_empty(spark, d):
    return ms.filter_types(feed.messages(spark, d), []).select("seq", "message_type", "stock_locate")


@query(_F + """SELECT seq, message_type,
    printf('%02d:%02d:%02d.%09d', ts_ns // 3600000000000, ts_ns // 60000000000 % 60, ts_ns // 1000000000 % 60, ts_ns % 1000000000) AS time FROM feed ORDER BY seq LIMIT 20""")
def inspect_limit(spark, d):
    frames = ms.encode(feed.messages(spark, d), list("AFECXDUPQBI")).select("seq", "message_type", "body")
    return ms.inspect(frames).select("seq", "message_type", "time")


@query(_F + "SELECT message_type, CASE WHEN message_type IN ('A', 'F') THEN 'add' WHEN message_type IN ('E', 'C', 'X', 'D', 'U') THEN 'modify' WHEN message_type IN ('P', 'Q', 'B') THEN 'trade' ELSE 'other' END AS category, count(*) AS n FROM feed GROUP BY ALL")
def message_category(spark, d):
    return feed.messages(spark, d).groupBy("message_type", ms.category(F.col("message_type")).alias("category")).agg(F.count(F.lit(1)).alias("n"))


_WIRE = list("AFECXDUPQBI")


@query(_F + "SELECT *, CASE message_type " + " ".join(f"WHEN '{c}' THEN {DEFAULT.size_of(c)}" for c in _WIRE) + " END AS wire_size FROM feed")
def wire_roundtrip(spark, d):
    rows = feed.messages(spark, d)
    frames = ms.encode(rows, _WIRE).select("session_date", "seq", "message_type", "body", F.octet_length("body").cast("int").alias("wire_size"))
    keep = [c for c in rows.columns if c not in ("session_date", "seq", "message_type")]
    return ms.unpack(frames, keep).select("session_date", "seq", "message_type", *keep, "wire_size")


def _decoder(code: str):
    t = DEFAULT.types[code]

    def literal(f, n: str) -> str:
        if f.kind == "a":
            return f"'{f.name.upper()[: f.size]}'"
        return f"CAST(({n} * 7919 + {f.offset}) % {256 ** min(f.size, 4) - 1} AS {'INT' if f.size == 2 else 'BIGINT'})"

    body = ", ".join(f"{literal(f, 'l_orderkey')} AS {f.name}" for f in t.fields[1:])
    trimmed = ", ".join(f"rtrim({f.name}) AS {f.name}" if f.kind == "a" and f.size > 1 else f.name for f in t.fields[1:])
    base = f"SELECT DISTINCT l_orderkey AS seq, '{code}' AS message_type, {body} FROM {{lineitem}}"

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = spark.sql(base, lineitem=load(spark, d, "lineitem"))
        return ms.decode(ms.encode(rows, [code]).select("seq", "message_type", "body"), code)

    run.__name__ = f"decode_{t.name}"
    sql = f"SELECT seq, message_type, {trimmed} FROM ({base.format(lineitem='lineitem')})"
    return query(sql)(run)


for _code in DEFAULT.types:
    _decoder(_code)


# scalars ---------------------------------------------------------------------------------------

@query(_F + "SELECT seq, price, CAST(price AS DOUBLE) / 10000.0 AS price_double, printf('%d.%04d', price // 10000, price % 10000) AS price_text, price * 10000 AS mwcb_raw, printf('%d.%08d', price * 10000 // 100000000, price * 10000 % 100000000) AS mwcb_text FROM feed WHERE price IS NOT NULL")
def price_scale(spark, d):
    p = F.col("price")
    rows = feed.messages(spark, d).where("price IS NOT NULL")
    raw8 = scalars.make_price(scalars.price_decimal(p), 8)
    return rows.select("seq", "price", scalars.price(p).alias("price_double"), scalars.price_text(p).alias("price_text"), raw8.alias("mwcb_raw"), scalars.price_text(raw8, 8).alias("mwcb_text"))


@query(_F + """SELECT seq, printf('%02d:%02d:%02d.%09d', ts_ns // 3600000000000, ts_ns // 60000000000 % 60, ts_ns // 1000000000 % 60, ts_ns % 1000000000) AS time_text,
    strftime(session_date, '%Y-%m-%d') || ' ' || printf('%02d:%02d:%02d.%09d', ts_ns // 3600000000000, ts_ns // 60000000000 % 60, ts_ns // 1000000000 % 60, ts_ns % 1000000000) AS moment_text,
    ts_ns // 4294967296 AS ts_high, ts_ns % 4294967296 AS ts_low FROM feed""")
def time_format(spark, d):
    rows = ms.with_timestamp_parts(feed.messages(spark, d))
    return rows.select("seq", scalars.time_text(F.col("ts_ns")).alias("time_text"), scalars.moment_text(F.col("session_date"), F.col("ts_ns")).alias("moment_text"), "ts_high", "ts_low")


@query(_F + "SELECT seq, CAST(session_date AS TIMESTAMP) + to_microseconds(ts_ns // 1000) AS moment FROM feed")
def time_point(spark, d):
    return feed.messages(spark, d).select("seq", scalars.moment(F.col("session_date"), F.col("ts_ns")).alias("moment"))


@query(_F + "SELECT seq, ts_ns // 4294967296 AS ts_high, ts_ns % 4294967296 AS ts_low, ts_ns AS joined FROM feed")
def timestamp_parts(spark, d):
    rows = ms.with_timestamp_parts(feed.messages(spark, d))
    return rows.select("seq", "ts_high", "ts_low", scalars.join_timestamp(F.col("ts_high"), F.col("ts_low")).alias("joined"))


@query(_F + "SELECT seq, CAST(price AS DOUBLE) / 10000.0 AS price, CAST(execution_price AS DOUBLE) / 10000.0 AS execution_price, CAST(far_price AS DOUBLE) / 10000.0 AS far_price FROM feed")
def prices_scaled(spark, d):
    return ms.scaled(feed.messages(spark, d)).select("seq", "price", "execution_price", "far_price")


@query(" UNION ALL ".join(f"SELECT '{t.code}' AS code, '{t.name}' AS name, CAST({sum(f.size for f in t.fields)} AS INT) AS wire_size, CAST({8 if t.code == 'V' else 4} AS INT) AS price_precision, CAST({len(t.fields)} AS INT) AS n_fields" for t in DEFAULT.types.values()))
def message_types(spark, d):
    """The registry: what each type is called, how long it is and how its prices are scaled."""
    return spark.createDataFrame([(c, t.name, t.wire_size, t.price_precision, len(t.fields)) for c, t in DEFAULT.types.items()], "code string, name string, wire_size int, price_precision int, n_fields int")


def _case(table: str, col: str, fallback: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in codes.TABLES[table].items()) + f" ELSE {fallback} END"


@query(_F + f"SELECT seq, {_case('CROSS_TYPE', 'cross_type', chr(39) + 'Unknown' + chr(39))} AS cross_name, {_case('IMBALANCE_DIRECTION', 'imbalance_direction', chr(39) + 'Unknown' + chr(39))} AS direction_name, {_case('PRICE_VARIATION_INDICATOR', 'price_variation_indicator', 'NULL')} AS variation FROM feed WHERE message_type = 'I'")
def code_lookup(spark, d):
    rows = feed.messages(spark, d).where("message_type = 'I'")
    return rows.select("seq", codes.cross_type_name(F.col("cross_type")).alias("cross_name"), codes.imbalance_direction_name(F.col("imbalance_direction")).alias("direction_name"), codes.describe("PRICE_VARIATION_INDICATOR", F.col("price_variation_indicator")).alias("variation"))


@query(f"SELECT msg_id, {_case('TRADING_STATES', 'trading_state', 'NULL')} AS state, {_case('TRADING_ACTION_REASON_CODES', 'CASE WHEN rtrim(reason) = ' + chr(39) * 2 + ' THEN ' + chr(39) + ' ' + chr(39) + ' ELSE rtrim(reason) END', 'NULL')} AS why FROM stock_trading_action")
def code_dimension(spark, d):
    rows = load(spark, d, "stock_trading_action")
    return rows.select("msg_id", codes.describe("TRADING_STATES", F.col("trading_state")).alias("state"), codes.describe("TRADING_ACTION_REASON_CODES", F.rtrim("reason")).alias("why"))


@query(" UNION ALL ".join(f"SELECT '{t}' AS code_table, '{k}' AS code, '{v}' AS meaning" for t, codes_of in codes.TABLES.items() for k, v in codes_of.items()))
def code_tables(spark, d):
    """Every code table, looked up by its own codes."""
    from functools import reduce

    parts = [codes.dimension(spark, t).select(F.lit(t).alias("code_table"), "code", codes.describe(t, F.col("code")).alias("meaning")) for t in codes.TABLES]
    return reduce(DataFrame.unionByName, parts)


def _text_sql() -> str:
    """What a person reads of a message, in SQL, from the same table of texts."""
    whens = []
    for line in ms._TEXTS.strip().splitlines():
        code, title, *lines = line.split("|")
        if code not in _WIRE:
            continue
        fields = {f.name: f for f in DEFAULT.types[code].body}
        parts = [f"'{title}'", "'  Timestamp: ' || ts_ns"]
        for x in lines:
            label, _, name = x.partition("%")
            value = f"printf('%g', CAST({name} AS DOUBLE) / {10 ** fields[name].decimals})" if fields[name].kind == "p" else f"CAST({name} AS VARCHAR)"
            parts.append(f"'  {label}' || {value}")
        whens.append(f"WHEN '{code}' THEN " + " || chr(10) || ".join(parts))
    return "CASE message_type " + " ".join(whens) + " END"


@query(_F + f"SELECT seq, {_text_sql()} AS text FROM feed")
def message_text(spark, d):
    rows = feed.messages(spark, d)
    return rows.select("seq", ms.text_of(rows).alias("text"))


_ONE = {"stock_locate": 7, "tracking_number": 3, "ts_ns": 34_200_000_000_001, "order_reference_number": 42, "buy_sell_indicator": "B", "shares": 500, "stock": "AAPL", "price": 1_500_000}


@query("SELECT " + ", ".join(f"{v!r} AS {k}" if isinstance(v, str) else f"CAST({v} AS {'INT' if k in ('stock_locate', 'tracking_number') else 'BIGINT'}) AS {k}" for k, v in {"message_type": "A", **_ONE}.items()) + ", CAST(36 AS INT) AS wire_size")
def message_created(spark, d):
    made = ms.create_message(spark, "A", **_ONE)
    return ms.decode(made.select("message_type", "body"), "A").join(made.select(F.octet_length("body").cast("int").alias("wire_size"), F.lit("A").alias("message_type")), "message_type")


_FLAT = """
    SELECT message_type, ts_ns AS timestamp, stock_locate, tracking_number, CASE WHEN message_type IN ('A', 'F', 'P', 'Q') THEN stock ELSE '' END AS symbol,
      {n0}coalesce(order_reference_number, new_order_reference_number){n1} AS reference_number, CASE WHEN message_type IN ('A', 'F', 'P') THEN buy_sell_indicator ELSE '' END AS side,
      {n0}coalesce(shares, executed_shares, cancelled_shares){n1} AS shares, {price} AS price, {n0}CASE WHEN message_type <> 'B' THEN match_number END{n1} AS match_number, coalesce(printable, '') AS printable,
      coalesce(CASE message_type WHEN 'F' THEN 'mpid=' || attribution WHEN 'U' THEN 'orig=' || original_order_reference_number WHEN 'Q' THEN 'cross=' || cross_type END, '') AS extra
    FROM (SELECT *, coalesce(price, execution_price, cross_price) AS px FROM feed)"""


@query(_F + _FLAT.format(n0="coalesce(CAST(", n1=" AS VARCHAR), '')", price="coalesce(printf('%d.%04d', px // 10000, px % 10000), '')"))
def export_flat_csv(spark, d):
    return export.flat(feed.messages(spark, d), True)


@query(_F + _FLAT.format(n0="", n1="", price="CAST(px AS DOUBLE) / 10000.0"))
def export_flat_parquet(spark, d):
    return export.flat(feed.messages(spark, d), False)


@query(_F + _FLAT.format(n0="coalesce(CAST(", n1=" AS VARCHAR), '')", price="coalesce(printf('%d.%04d', px // 10000, px % 10000), '')").replace("SELECT message_type, ts_ns AS timestamp", "SELECT concat_ws(',', message_type, timestamp, stock_locate, tracking_number, symbol, reference_number, side, shares, price, match_number, printable, extra) AS line FROM (SELECT message_type, ts_ns AS timestamp", 1) + ")")
def export_csv_bytes(spark, d):
    """The lines of the CSV files as they are written."""
    from tidebook.runtime import new_path

    path = new_path(spark, "csv")
    export.write_csv(feed.messages(spark, d), path)
    return spark.read.text(path).where(F.col("value") != ",".join(export.COLUMNS)).withColumnRenamed("value", "line")


# books and tape --------------------------------------------------------------------------------

_TRADE_COLS = "session_date, stock_locate, seq, ts_ns, symbol, side, shares, price, match_number, printable, is_cross, cross_type"


@query(_TAPE + f"SELECT {_TRADE_COLS} FROM trades")
def trade_tape(spark, d):
    return _tape(spark, d)


@query(_TAPE + f"SELECT {_TRADE_COLS} FROM trades WHERE NOT EXISTS (SELECT 1 FROM feed b WHERE b.message_type = 'B' AND b.match_number = trades.match_number AND b.session_date = trades.session_date)")
def trade_tape_unbroken(spark, d):
    m = feed.messages(spark, d)
    return bk.without_broken(bk.rebuild(m, "trades"), m)


@query(_BOOK + "SELECT session_date, stock_locate, seq, side, price, CAST(d_shares AS BIGINT) AS d_shares, CAST(d_orders AS INT) AS d_orders FROM deltas")
def book_level_deltas(spark, d):
    return bk.rebuild(feed.messages(spark, d), "deltas").select("session_date", "stock_locate", "seq", "side", "price", "d_shares", "d_orders")


def _orders(spark, d):
    return bk.rebuild(feed.messages(spark, d), "orders")


@query(_BOOK + "SELECT session_date, stock_locate, born AS seq, ref AS order_reference_number, side, shares, price FROM orders")
def live_orders(spark, d):
    return _orders(spark, d).select("session_date", "stock_locate", "seq", "order_reference_number", "side", "shares", "price")


@query(_BOOK + "SELECT session_date, stock_locate, side, price, shares, order_count, level FROM depth")
def depth_final(spark, d):
    return bk.levels(_orders(spark, d))


@query(_BOOK + "SELECT session_date, stock_locate, side, price, shares, order_count, level FROM depth WHERE level <= 5")
def depth_topk(spark, d):
    return bk.levels(_orders(spark, d), 5)


@query(_BOOK + "SELECT session_date, stock_locate, side, CAST(sum(shares) AS BIGINT) AS shares FROM depth WHERE level <= 3 GROUP BY ALL")
def depth_at_level(spark, d):
    return an.depth_at(bk.levels(_orders(spark, d)), 3)


@query(_BOOK + "SELECT session_date, stock_locate, ref AS order_reference_number, side, price, row_number() OVER (PARTITION BY session_date, stock_locate, side, price ORDER BY born, ref) AS position FROM orders")
def orders_queue(spark, d):
    return bk.queue(_orders(spark, d)).select("session_date", "stock_locate", "order_reference_number", "side", "price", "position")


@query(_F + "SELECT session_date, stock_locate, arg_min(stock, seq) AS symbol, min(seq) AS first_seq FROM feed WHERE message_type IN ('A', 'F') GROUP BY session_date, stock_locate")
def book_index(spark, d):
    return bk.book_index(feed.messages(spark, d))


@query(_F + "SELECT DISTINCT session_date, stock_locate, 'SYM' || stock_locate AS symbol FROM feed WHERE message_type IN ('A', 'F')")
def symbol_by_locate(spark, d):
    return bk.symbols(feed.messages(spark, d))


@query(_BOOK + """SELECT session_date, stock_locate, count(*) FILTER (WHERE side = 'B') AS bid_levels, count(*) FILTER (WHERE side = 'S') AS ask_levels, CAST(sum(order_count) AS BIGINT) AS n_orders,
    CAST(sum(shares) AS BIGINT) AS shares FROM depth GROUP BY ALL""")
def book_counts(spark, d):
    """Levels, orders and shares of each book at the end."""
    bid = F.col("side") == "B"
    return bk.levels(_orders(spark, d)).groupBy("session_date", "stock_locate").agg(F.count_if(bid).alias("bid_levels"), F.count_if(~bid).alias("ask_levels"), F.sum("order_count").alias("n_orders"), F.sum("shares").alias("shares"))


_TOP = """SELECT session_date, stock_locate, bool_or(side = 'B') AS has_bid, coalesce(max(price) FILTER (WHERE side = 'B'), 0) AS bid_price, coalesce(max(shares) FILTER (WHERE side = 'B'), 0) AS bid_shares,
    bool_or(side = 'S') AS has_ask, coalesce(max(price) FILTER (WHERE side = 'S'), 0) AS ask_price, coalesce(max(shares) FILTER (WHERE side = 'S'), 0) AS ask_shares FROM depth WHERE level = 1 GROUP BY session_date, stock_locate"""


@query(_BOOK + _TOP)
def bbo_final(spark, d):
    return bk.tops(_orders(spark, d))


# level counts after each change hold until the level's next one; the best of those that hold at
# each of the instrument's changes is its top
_BBO = _BOOK + """,
moves AS (SELECT session_date, stock_locate, side, price, seq, sum(d_shares) AS ds, sum(d_orders) AS dn FROM deltas GROUP BY ALL),
held AS (
  SELECT *, sum(ds) OVER w AS shares, sum(dn) OVER w AS n, coalesce(lead(seq) OVER w, 9223372036854775807) AS until
  FROM moves WINDOW w AS (PARTITION BY session_date, stock_locate, side, price ORDER BY seq)),
moments AS (SELECT DISTINCT session_date, stock_locate, seq FROM moves),
sides AS (
  SELECT m.session_date, m.stock_locate, m.seq, max(h.price) FILTER (WHERE side = 'B') AS b, min(h.price) FILTER (WHERE side = 'S') AS a, arg_max(h.shares, h.price) FILTER (WHERE side = 'B') AS bs, arg_min(h.shares, h.price) FILTER (WHERE side = 'S') AS as_
  FROM moments m LEFT JOIN held h ON h.session_date = m.session_date AND h.stock_locate = m.stock_locate AND h.seq <= m.seq AND m.seq < h.until AND h.n > 0 GROUP BY ALL),
states AS (
  SELECT session_date, stock_locate, seq, b IS NOT NULL AS has_bid, coalesce(b, 0) AS bid_price, CAST(coalesce(bs, 0) AS BIGINT) AS bid_shares, a IS NOT NULL AS has_ask, coalesce(a, 0) AS ask_price, CAST(coalesce(as_, 0) AS BIGINT) AS ask_shares FROM sides),
bbos AS (
  SELECT * FROM states QUALIFY row(has_bid, bid_price, bid_shares, has_ask, ask_price, ask_shares) IS DISTINCT FROM
    coalesce(lag(row(has_bid, bid_price, bid_shares, has_ask, ask_price, ask_shares)) OVER (PARTITION BY session_date, stock_locate ORDER BY seq), row(false, CAST(0 AS BIGINT), CAST(0 AS BIGINT), false, CAST(0 AS BIGINT), CAST(0 AS BIGINT))))
"""


def _bbo(spark, d):
    return bk.rebuild(feed.messages(spark, d), "bbo")


@query(_BBO + "SELECT * FROM bbos")
def bbo_changes(spark, d):
    return _bbo(spark, d).drop("ts_ns")


@query(_BBO + """SELECT session_date, stock_locate, seq, CASE WHEN has_bid AND has_ask THEN CAST(ask_price - bid_price AS DOUBLE) / 10000.0 END AS spread, CASE WHEN has_bid AND has_ask THEN CAST(ask_price + bid_price AS DOUBLE) / 20000.0 END AS mid,
    CASE WHEN bid_shares + ask_shares <> 0 THEN CAST(bid_shares - ask_shares AS DOUBLE) / CAST(bid_shares + ask_shares AS DOUBLE) END AS queue_imbalance FROM bbos""")
def spread_mid_qi(spark, d):
    return _bbo(spark, d).select("session_date", "stock_locate", "seq", an.spread().alias("spread"), an.mid_price().alias("mid"), an.queue_imbalance().alias("queue_imbalance"))


_OFI = """, p AS (SELECT *, lag(bid_price) OVER w AS pb, lag(bid_shares) OVER w AS pbs, lag(ask_price) OVER w AS pa, lag(ask_shares) OVER w AS pas FROM {0} WINDOW w AS (PARTITION BY {1} ORDER BY {2}))
    SELECT {1}, {2}, CAST(CASE WHEN bid_price > pb THEN bid_shares WHEN bid_price = pb THEN bid_shares - pbs WHEN bid_price < pb THEN -pbs END
      - CASE WHEN ask_price > pa THEN pas WHEN ask_price = pa THEN ask_shares - pas WHEN ask_price < pa THEN -ask_shares END AS BIGINT) AS ofi FROM p"""


@query(_BBO + _OFI.format("bbos", "session_date, stock_locate", "seq"))
def ofi(spark, d):
    return an.order_flow_imbalance(_bbo(spark, d), BY, BLOCK).select("session_date", "stock_locate", "seq", "ofi")


@query("WITH q AS (SELECT DISTINCT * FROM bbo)" + _OFI.format("q", "session_date, stock_locate", "bbo_id"))
def ofi_quotes(spark, d):
    """The same over the stored quotes, in the order of their ids."""
    rows = load(spark, d, "bbo").distinct().withColumnRenamed("bbo_id", "seq")
    out = an.order_flow_imbalance(rows, ["session_date", "stock_locate"], BLOCK)
    return out.select("session_date", "stock_locate", F.col("seq").alias("bbo_id"), "ofi")


@query(_F + """, u AS (SELECT f.* FROM feed f, (SELECT session_date, stock_locate, min(seq) AS s FROM feed WHERE message_type IN ('A', 'F') AND stock IN ('SYM1', 'SYM3') GROUP BY session_date, stock_locate) b WHERE f.session_date = b.session_date AND f.stock_locate = b.stock_locate AND f.message_type IN ('A', 'F') AND f.seq >= b.s)
    SELECT session_date, stock_locate, count(*) AS n_adds FROM u GROUP BY session_date, stock_locate""")
def universe_filter(spark, d):
    deltas = bk.rebuild(feed.messages(spark, d), "deltas", {"SYM1", "SYM3"})
    adds = feed.messages(spark, d).where("message_type IN ('A', 'F')").select("seq", "session_date", "stock_locate")
    return deltas.select("seq").distinct().join(adds, "seq").groupBy("session_date", "stock_locate").agg(F.count(F.lit(1)).alias("n_adds"))


_LINES = """, lines AS (
    SELECT session_date, stock_locate, CASE side WHEN 'B' THEN 4 ELSE 2 END AS part, -price AS k, printf('%10d | %12.4f | %s', shares, price / 10000.0, CASE side WHEN 'B' THEN 'Bid' ELSE 'Ask' END) AS line FROM depth
    UNION ALL SELECT session_date, stock_locate, part, k, line FROM (SELECT DISTINCT session_date, stock_locate FROM depth) b,
      (VALUES (1, 0, repeat('=', 42)), (1, 1, '   SHARES  |    PRICE     | SIDE '), (1, 2, repeat('=', 42)), (3, 0, '-----------+--------------+--------------'), (5, 0, repeat('=', 42))) f(part, k, line))
    SELECT session_date, stock_locate, row_number() OVER (PARTITION BY session_date, stock_locate ORDER BY part, k) AS line_no, line FROM lines"""


@query(_BOOK + _LINES)
def ladder_print(spark, d):
    return bk.ladder_text(bk.levels(_orders(spark, d)))


def _whole_only(spark, d):
    """The feed without what takes more off an order than a single-symbol ladder expects."""
    return feed.messages(spark, d).where("message_type IN ('A', 'F', 'D', 'U')")


@query("WITH RECURSIVE " + feed.SQL.lstrip().replace("FROM aimed)", "FROM aimed WHERE message_type IN ('A', 'F', 'D', 'U'))") + _BOOK.split(feed.SQL.lstrip(), 1)[1] + """
    SELECT session_date, side, price, shares, CAST(order_count AS INT) AS order_count FROM depth WHERE stock_locate = 3""")
def legacy_ladder(spark, d):
    """The single-symbol ladder of one symbol, which reads all locates."""
    from tidebook.operators.legacy import ladder

    return ladder(_whole_only(spark, d), "SYM3")


# auctions, imbalance, transport ----------------------------------------------------------------

@query(_F + """SELECT seq, ts_ns, stock_locate, stock, CAST(far_price AS DOUBLE) / 10000.0 AS far_price, CAST(near_price AS DOUBLE) / 10000.0 AS near_price, CAST(current_reference_price AS DOUBLE) / 10000.0 AS current_reference_price,
    paired_shares, imbalance_shares, imbalance_direction, price_variation_indicator, cross_type FROM feed WHERE message_type = 'I'""")
def imbalance_info(spark, d):
    return an.imbalance_info(feed.messages(spark, d))


@query(_F + """, a AS (SELECT q.seq AS q, max(i.seq) AS i FROM feed q LEFT JOIN feed i ON i.message_type = 'I' AND i.session_date = q.session_date AND i.stock_locate = q.stock_locate AND i.seq < q.seq WHERE q.message_type = 'Q' GROUP BY q.seq)
    SELECT q.session_date, q.stock_locate, q.seq, q.ts_ns, q.stock, q.shares, q.cross_price, q.match_number, q.cross_type, i.seq IS NOT NULL AS has_imbalance, i.paired_shares, i.imbalance_shares, i.imbalance_direction, i.far_price, i.near_price, i.current_reference_price, i.price_variation_indicator
    FROM a JOIN feed q ON q.seq = a.q LEFT JOIN feed i ON i.seq = a.i""")
def auctions(spark, d):
    return an.auctions(feed.messages(spark, d), BY, BLOCK)


# packets of 7 messages a session (user_id % 3); every fifth is lost, every eleventh comes twice
_PACKETS = """
    SELECT session, packet * 2 + copy AS packet, first_seq, msg_count FROM (
      SELECT session, packet, min(n) AS first_seq, count(*) AS msg_count, {copies} AS copy FROM (
        SELECT concat('S', CAST(user_id % 3 AS {text})) AS session, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS n, event_id, CAST(floor((row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) - 1) / 7) AS BIGINT) AS packet FROM {events}) x
      GROUP BY session, packet) y
    WHERE packet % 5 <> 3 AND (copy = 0 OR packet % 11 = 0)
"""


def _packets(spark, d):
    return spark.sql(_PACKETS.replace("{text}", "STRING").replace("{copies}", "explode(array(0, 1))"), events=load(spark, d, "events"))


_GAPS = f"WITH p AS ({_PACKETS.format(text='VARCHAR', copies='unnest([0, 1])', events='events')})" + """, g AS (
    SELECT *, max(first_seq + msg_count) OVER (PARTITION BY session ORDER BY packet ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS expected FROM p),
    s AS (SELECT *, CAST(CASE WHEN expected IS NULL THEN 0 ELSE greatest(first_seq - expected, 0) END AS BIGINT) AS missing,
      CAST(CASE WHEN expected IS NULL THEN msg_count WHEN first_seq + msg_count > expected THEN msg_count - least(msg_count, greatest(expected - first_seq, 0)) ELSE 0 END AS BIGINT) AS fresh FROM g)
"""


@query(_GAPS + "SELECT session, packet, first_seq, msg_count, expected, missing, fresh FROM s WHERE missing > 0")
def sequence_gaps(spark, d):
    return an.sequence_gaps(_packets(spark, d), block=64).where("missing > 0")


@query(_GAPS + "SELECT session, max(first_seq + msg_count) AS expected_next, CAST(sum(fresh) AS BIGINT) AS messages_seen, CAST(sum(missing) AS BIGINT) AS gap_count FROM s GROUP BY session")
def sequence_summary(spark, d):
    return an.sequence_summary(an.sequence_gaps(_packets(spark, d), block=64))


# the data source and a stream over the same feed --------------------------------------------------

def _frames(spark: SparkSession, d: str) -> DataFrame:
    return ms.encode(feed.messages(spark, d), _WIRE).select("session_date", "seq", "body")


def _written(spark: SparkSession, rows: DataFrame, framed: bool = True, parts: int | None = None) -> str:
    """``rows`` (seq, body) as files in the shared folder."""
    from tidebook.runtime import new_path
    from tidebook.sources.feed import write_stream

    path = new_path(spark, "day")
    write_stream(rows, path, framed=framed, parts=parts)
    return path


# where every message stands in the file: after all before it, each with its length
_PLACED = _F + """, sized AS (SELECT *, 2 + CASE message_type """ + " ".join(f"WHEN '{c}' THEN {DEFAULT.size_of(c)}" for c in _WIRE) + """ END AS bytes FROM feed),
    placed AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY seq) AS BIGINT) - bytes AS place, row_number() OVER (ORDER BY seq) - 1 AS n FROM sized)"""


@query(_PLACED + "SELECT place, message_type, stock_locate, ts_ns, order_reference_number FROM placed WHERE message_type IN ('A', 'E', 'D')")
def source_raw(spark, d):
    """Written as bytes, read again, filtered at the source and decoded."""
    from tidebook.sources.feed import read_frames

    frames = ms.filter_types(read_frames(spark, _written(spark, _frames(spark, d), parts=1), framing="raw"), "AED")
    return ms.wide(frames).select(F.col("seq").alias("place"), "message_type", "stock_locate", "ts_ns", "order_reference_number")


@query(_F + "SELECT message_type, count(*) AS n, CAST(sum(stock_locate) AS BIGINT) AS sum_locate, CAST(sum(ts_ns % 1000000007) AS BIGINT) AS sum_ts FROM feed GROUP BY message_type")
def source_split(spark, d):
    """The same file read by many tasks."""
    from tidebook.sources.feed import read_frames

    wide = ms.wide(read_frames(spark, _written(spark, _frames(spark, d), parts=1), framing="raw", splitBytes=50_000).where("error IS NULL"))
    return wide.groupBy("message_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stock_locate").cast("long")).alias("sum_locate"), F.sum(F.expr("ts_ns % 1000000007")).alias("sum_ts"))


@query(_F + "SELECT CAST(0 AS BIGINT) AS n_faults")
def source_ranges_meet(spark, d):
    """Where tasks that read the file in pieces do not meet."""
    from tidebook.sources.feed import split_faults

    return split_faults(spark, _written(spark, _frames(spark, d), parts=1), splitBytes=50_000).agg(F.count(F.lit(1)).alias("n_faults"))


@query(_PLACED + "SELECT place, message_type, stock_locate, ts_ns, stock, buy_sell_indicator, price, match_number FROM placed")
def source_decoded(spark, d):
    """Decoded where it is read."""
    from tidebook.sources.feed import read_messages

    path = _written(spark, _frames(spark, d), parts=1)
    return read_messages(spark, path, ["stock_locate", "ts_ns", "stock", "buy_sell_indicator", "price", "match_number"], ["seq"], splitBytes=70_000).withColumnRenamed("seq", "place")


@query(_F + """, h AS (SELECT *, seq * 2 > (SELECT max(seq) FROM feed) AS late FROM feed)
    SELECT CASE WHEN late THEN CAST('2020-01-31' AS DATE) ELSE CAST('2020-01-30' AS DATE) END AS session_date, message_type, count(*) AS n, min(ts_ns) AS first_ts, max(ts_ns) AS last_ts FROM h GROUP BY ALL""")
def source_two_days(spark, d):
    """Files of two days in one read, their dates from their names."""
    import os
    import shutil

    from tidebook.sources.feed import read_messages

    rows = _frames(spark, d)
    edge = rows.agg(F.max("seq")).first()[0] or 0
    days = {n: _written(spark, rows.where((F.col("seq") * 2 > edge) == F.lit(n == "01312020")), parts=2) for n in ("01302020", "01312020")}
    root = days["01302020"].removeprefix("file://").removeprefix("file:") + "-both"
    if "://" in root:
        raise ValueError("the files are copied in a mounted folder")
    os.makedirs(root)
    for n, p in days.items():
        for x in sorted(os.listdir(p.removeprefix("file://").removeprefix("file:"))):
            if x.startswith("part-"):
                shutil.copyfile(os.path.join(p.removeprefix("file://").removeprefix("file:"), x), os.path.join(root, f"{n}.{x}"))
    got = read_messages(spark, root, ["ts_ns"], date_format="%m%d%Y")
    return got.groupBy("session_date", "message_type").agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ts"), F.max("ts_ns").alias("last_ts"))


@query(_F + "SELECT CASE WHEN seq % 10 = 1 THEN 'unknown_type' WHEN seq % 10 = 0 THEN 'size_mismatch' ELSE 'ok' END AS error, count(*) AS n FROM feed GROUP BY ALL")
def source_diagnostics(spark, d):
    """A file of which every tenth body is cut short and every tenth of no known type."""
    from tidebook.sources.feed import diagnostics, read_frames

    bad = _frames(spark, d).selectExpr("seq", "CASE WHEN seq % 10 = 1 THEN concat(encode('?', 'ISO-8859-1'), body) WHEN seq % 10 = 0 THEN substring(body, 1, 8) ELSE body END AS body")
    return diagnostics(read_frames(spark, _written(spark, bad), framing="raw"))


@query(_F + "SELECT message_type, count(*) AS n FROM feed WHERE seq % 10 > 1 GROUP BY message_type")
def source_dropmalformed(spark, d):
    """The same, bad bodies left out."""
    from tidebook.sources.feed import read_frames

    bad = _frames(spark, d).selectExpr("seq", "CASE WHEN seq % 10 = 1 THEN concat(encode('?', 'ISO-8859-1'), body) WHEN seq % 10 = 0 THEN substring(body, 1, 8) ELSE body END AS body")
    return read_frames(spark, _written(spark, bad), framing="raw", mode="dropmalformed").groupBy("message_type").agg(F.count(F.lit(1)).alias("n"))


@query(_F + "SELECT count(*) + 1 AS n FROM feed WHERE seq <= 2000")
def source_stop_at_end(spark, d):
    """A system event that ends the session stands after 2000 messages; nothing behind it is read."""
    from tidebook.sources.feed import read_frames

    end = ms.create_message(spark, "S", event_code="C").select(F.lit(2000.5).alias("seq"), "body")
    rows = _frames(spark, d).select(F.col("seq").cast("double").alias("seq"), "body").unionByName(end.select(F.col("seq").cast("double"), "body"))
    return read_frames(spark, _written(spark, rows, parts=1), stop_at_end=True).agg(F.count(F.lit(1)).alias("n"))


@query(_F + "SELECT CASE WHEN message_type IN ('A', 'E') THEN 'ok' ELSE 'unknown_type' END AS error, count(*) AS n FROM feed GROUP BY ALL")
def source_venue(spark, d):
    """Read by a registry that knows two of the types."""
    from tidebook.functions.layout import ORDER_FEED, Venue
    from tidebook.sources.feed import diagnostics, read_frames

    venue = Venue("two", "\n".join(x for x in ORDER_FEED.strip().splitlines() if x[0] in "AE"))
    return diagnostics(read_frames(spark, _written(spark, _frames(spark, d), parts=1), venue=venue, framing="raw"))


@query(_F + """SELECT printf('%5s %d', message_type, count(*)) AS line FROM feed GROUP BY message_type UNION ALL SELECT printf('%5s %d', 'TOTAL', count(*)) FROM feed""")
def cli_stats(spark, d):
    """What the command line prints of a file."""
    import contextlib
    import io

    from tidebook import cli

    out, path = io.StringIO(), _written(spark, _frames(spark, d), parts=1).removeprefix("file://").removeprefix("file:")
    with contextlib.redirect_stdout(out):
        cli.main(["stats", f"{path}/part-000000.bin"], spark)
    return spark.createDataFrame([(x,) for x in out.getvalue().splitlines()], "line string")


@query(_F + "SELECT seq, message_type FROM feed")
def stream_once(spark, d):
    """Every message delivered twice to a stream comes out once."""
    from tidebook.runtime import new_path
    from tidebook.streaming.folds import once_within

    rows = feed.messages(spark, d).select("seq", "message_type", F.lit("S").alias("session"), F.lit(1).cast("long").alias("packet_first"), F.timestamp_seconds(F.col("seq") / 1000).alias("at"))
    parts, out, state = (new_path(spark, x) for x in ("twice", "once", "state"))
    rows.unionByName(rows).write.parquet(parts)
    s = once_within(spark.readStream.schema(rows.schema).parquet(parts), "at", "1 hour")
    s.select("seq", "message_type").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("seq long, message_type string").parquet(out)


@query(_F + "SELECT CAST(ceil(count(*) / 7.0) AS BIGINT) AS packets, count(*) AS messages, CAST(count(*) AS BIGINT) AS frames, true AS in_sequence FROM feed")
def source_packets(spark, d):
    """Counters of a transport: packets, the messages they announce and the frames they hold."""
    from tidebook.sources.feed import read_frames

    path = _written(spark, _packed(spark, d, 7).selectExpr("seq", f"unhex({_MOLD}) AS body"), parts=1)
    p = read_frames(spark, path, framing="mold", emit="packets")
    gaps = an.sequence_gaps(p, block=64)
    return gaps.agg(F.count(F.lit(1)).alias("packets"), F.sum(F.col("msg_count").cast("long")).alias("messages"), F.sum(F.col("n_frames").cast("long")).alias("frames"), (F.sum("missing") == 0).alias("in_sequence"))


def _packed(spark: SparkSession, d: str, of: int) -> DataFrame:
    """Downstream packets of ``of`` messages: ``seq``, ``n`` of messages and ``blocks``, hex."""
    rows = _frames(spark, d).selectExpr(f"(seq - 1) div {of} AS packet", "seq", "hex(body) AS h", "octet_length(body) AS size")
    # ``of`` blocks a group
    return rows.groupBy("packet").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.expr("array_join(transform(array_sort(collect_list(struct(seq, size, h))), x -> concat(lpad(hex(x.size), 4, '0'), x.h)), '')").alias("blocks"))


_MOLD = "concat(hex(encode('SESSION1  ', 'ISO-8859-1')), lpad(hex(seq), 16, '0'), lpad(hex(n), 4, '0'), blocks)"
_IN_PACKETS = _F + """ SELECT 'SESSION1' AS session, (seq - 1) // {0} * {0} + 1 AS packet_first, message_type, stock_locate, ts_ns, order_reference_number FROM feed"""
_PACKET_COLS = ["session", "packet_first", "message_type", "stock_locate", "ts_ns", "order_reference_number"]


@query(_IN_PACKETS.format(7))
def source_mold(spark, d):
    """Through UDP session packets of 7 messages."""
    from tidebook.sources.feed import read_frames

    path = _written(spark, _packed(spark, d, 7).selectExpr("seq", f"unhex({_MOLD}) AS body"))
    return ms.wide(read_frames(spark, path, framing="mold")).select(*_PACKET_COLS)


@query(_IN_PACKETS.format(1))
def source_soup(spark, d):
    """Through a TCP session: a login, then a packet a message."""
    from tidebook.sources.feed import read_frames

    login = spark.range(1).selectExpr("CAST(0 AS BIGINT) AS seq", "encode(concat('A', 'SESSION1  ', lpad('1', 20, ' ')), 'ISO-8859-1') AS body")
    rows = _frames(spark, d).selectExpr("seq", "concat(encode('S', 'ISO-8859-1'), body) AS body")
    return ms.wide(read_frames(spark, _written(spark, login.unionByName(rows), parts=1), framing="soup")).select(*_PACKET_COLS)


@query(_IN_PACKETS.format(5))
def source_pcap(spark, d):
    """Through a capture of Ethernet frames with IPv4 and UDP."""
    from tidebook.sources.feed import read_frames

    udp = "concat(lpad(hex(20000), 4, '0'), lpad(hex(26477), 4, '0'), lpad(hex(octet_length(unhex(m)) + 8), 4, '0'), '0000', m)"
    ether = f"concat(repeat('00', 12), '0800', '45', repeat('00', 8), '11', repeat('00', 10), {udp})"
    swap = "concat(substring(l, 7, 2), substring(l, 5, 2), substring(l, 3, 2), substring(l, 1, 2))"
    rows = _packed(spark, d, 5).selectExpr("seq", f"{_MOLD} AS m").selectExpr("seq", f"{ether} AS e").selectExpr("seq", "e", "lpad(hex(length(e) div 2), 8, '0') AS l")
    records = rows.selectExpr("seq", f"unhex(concat(repeat('00', 8), {swap}, {swap}, e)) AS body")
    head = spark.range(1).selectExpr("CAST(0 AS BIGINT) AS seq", "unhex('D4C3B2A1020004000000000000000000FFFF000001000000') AS body")
    path = _written(spark, head.unionByName(records), framed=False, parts=1)
    return ms.wide(read_frames(spark, path, dst_port=26477)).select(*_PACKET_COLS)


@query(_F + "SELECT message_type, count(*) AS n, true AS in_order FROM feed GROUP BY message_type")
def stream_replay(spark, d):
    """The file replayed at once as a stream."""
    from tidebook.runtime import new_path
    from tidebook.sources.feed import register

    register(spark)
    path, out, state = _written(spark, _frames(spark, d), parts=1), new_path(spark, "replayed"), new_path(spark, "state")
    s = spark.readStream.format("tidereplay").option("path", path).option("speed", "0").load()
    q = s.select("seq", "message_type", "body").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    rows = ms.wide(spark.read.parquet(out))
    return rows.groupBy("message_type").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("seq") >= 0).alias("in_order"))


@query(_F + "SELECT message_type, count(*) AS n, CAST(sum(stock_locate) AS BIGINT) AS sum_locate FROM feed GROUP BY message_type")
def stream_growing(spark, d):
    """A file read as a stream, twice while it grows, in pieces."""
    import os

    from tidebook.runtime import new_path
    from tidebook.sources.feed import register

    register(spark)
    path, out, state = _written(spark, _frames(spark, d), parts=1), new_path(spark, "grown"), new_path(spark, "state")
    source = path.removeprefix("file://").removeprefix("file:") + "/part-000000.bin"
    with open(source, "rb") as f:
        data = f.read()
    for size in (len(data) // 3 + 5, len(data)):
        with open(source + ".next", "wb") as f:
            f.write(data[:size])
        os.replace(source + ".next", source)
        s = spark.readStream.format("tidefeed").option("path", source).option("splitBytes", 60_000).option("columns", "seq,message_type,body").load()
        s.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    rows = ms.wide(spark.read.parquet(out))
    return rows.groupBy("message_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stock_locate").cast("long")).alias("sum_locate"))


@query(_bars_sql("(row_number() OVER (PARTITION BY session_date, stock_locate ORDER BY seq) - 1) // 5").replace("SELECT session_date, stock_locate, CAST(bar AS BIGINT)", "SELECT session_date, stock_locate, bar, open, high, low, close, volume, n_trades FROM (SELECT session_date, stock_locate, CAST(bar AS BIGINT)", 1)
       + " QUALIFY bar < max(bar) OVER (PARTITION BY session_date, stock_locate))")
def stream_bars(spark, d):
    """Bars of five trades from a stream that takes the tape in two batches; the last bar of each
    instrument is still open."""
    from tidebook.runtime import materialize, new_path
    from tidebook.streaming import folds

    tape = materialize(_tape(spark, d), "tape")
    parts, out, state = (new_path(spark, x) for x in ("parts", "bars", "state"))
    edge = tape.agg(F.max("seq")).first()[0] or 0
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for late in (False, True):
            tape.where((F.col("seq") * 2 > edge) == F.lit(late)).write.mode("append").parquet(parts)
            stream = spark.readStream.schema(tape.schema).parquet(parts)
            folds.stream_bars(stream, "tick", 5).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(out).select("session_date", "stock_locate", "bar", "open", "high", "low", "close", "volume", "n_trades")


@query(_BBO + "SELECT * FROM bbos")
def stream_bbo_changes(spark, d):
    """``bbo_changes`` from a stream that takes the feed in three batches."""
    from tidebook.runtime import new_path
    from tidebook.streaming.folds import stream_books

    parts, out, state = (new_path(spark, x) for x in ("parts", "tops", "state"))
    feed_rows = feed.messages(spark, d)
    edges = feed_rows.agg(F.min("seq").alias("a"), F.max("seq").alias("b")).first()
    step = max(1, ((edges.b or 0) - (edges.a or 0)) // 3 + 1)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i in range(3):  # each run of the stream takes what has come since the last
            lo = (edges.a or 0) + i * step
            feed_rows.where((F.col("seq") >= lo) & (F.col("seq") < lo + step)).write.mode("append").parquet(parts)
            stream = spark.readStream.schema(feed_rows.schema).parquet(parts)
            stream_books(stream, "bbo").writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return spark.read.parquet(out).drop("ts_ns")
