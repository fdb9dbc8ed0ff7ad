"""The life of every order, by the order, in SQL: what each message found and took.

A book is one instrument's, but what a message does to an order depends on that order alone, and on
the order it replaced. So messages are shuffled by session date, locate and reference, not by
instrument: an instrument with a tenth of the feed is as many keys as it has orders. Running sums
within a key's segments between ends tell of each message whether its order was live, what was left of it
and whether it ended; replacements that failed are struck out (see ``changefeed``). The side of an order that a replacement opened is that of
the first order of its chain, found by pointer doubling over the replacements alone.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators.changefeed import KEYS, SEQ_BLOCK, segments, settle
from tidebook.operators.hot import HOT_ROWS, hot_keys
from tidebook.runtime import materialize

#: Stand for a missing date or locate, which form a session or instrument of their own.
NO_DATE, NO_LOCATE = "DATE'0001-01-01'", -1


def starts(rows: DataFrame, universe: Collection[str] | None) -> DataFrame:
    """``period``, ``part``, ``start`` and ``symbol`` of each book: its locate's first add of the universe."""
    adds = rows.where(F.col("message_type").isin("A", "F"))
    if universe:
        adds = adds.where(F.col("stock").isin(*universe))
    return adds.groupBy("period", "part").agg(F.min("seq").alias("start"), F.min_by("stock", "seq").alias("symbol"))


def keyed(rows: DataFrame) -> DataFrame:
    """``book_rows`` with ``period`` and ``part``, which are never null."""
    return rows.selectExpr("*", f"coalesce(session_date, {NO_DATE}) AS period", f"coalesce(stock_locate, {NO_LOCATE}) AS part")


def order_changes(rows: DataFrame) -> DataFrame:
    """A row for each order that a message names: the feed of ``changefeed`` with what the message says
    in ``m``. A replacement is an end of one order and the birth of another."""
    return rows.sparkSession.sql(
        """
        SELECT period, part, seq, m, inline(CASE
          WHEN message_type = 'U' THEN array(named_struct('id', ref, 'kind', 1, 'qty', CAST(NULL AS BIGINT)), named_struct('id', new_ref, 'kind', 3, 'qty', qty))
          ELSE array(named_struct('id', ref, 'kind', CASE WHEN message_type IN ('A', 'F') THEN 2 WHEN message_type = 'D' THEN 0 ELSE 4 END, 'qty', qty)) END)
        FROM (SELECT period, part, seq, ref, new_ref, message_type, coalesce(shares, 0) AS qty,
          struct(ts_ns, message_type, CASE WHEN side = 'B' THEN 'B' ELSE 'S' END AS side, coalesce(price, 0) AS price, shares, price AS said_price, match_number, printable) AS m FROM {rows})
        """,
        rows=rows,
    ).where("id IS NOT NULL")


_LIVES = """
    WITH w AS (
      SELECT *, count(CASE WHEN kind IN (2, 3) THEN 1 END) OVER run AS births, first(CASE WHEN kind IN (2, 3) THEN struct(qty, kind, seq, m.side AS side, m.price AS price, m.ts_ns AS ts_ns) END, true) OVER run AS b
      FROM {rows} WINDOW run AS (PARTITION BY period, part, id, seg, life ORDER BY seq, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    u AS (
      SELECT *, coalesce(sum(CASE WHEN kind = 4 AND births > 0 THEN qty END) OVER run, 0) AS used, max(CASE WHEN kind = 4 AND births > 0 THEN 1 ELSE 0 END) OVER run AS reduced
      FROM w WINDOW run AS (PARTITION BY period, part, id, seg, life ORDER BY seq, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    x AS (
      SELECT *, reduced = 1 AND used >= b.qty AS gone, coalesce(max(reduced = 1 AND used >= b.qty) OVER before, false) AS gone_before
      FROM u WINDOW before AS (PARTITION BY period, part, id, seg, life ORDER BY seq, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT period, part, id, seq, m, kind, qty, seg, life, is_last, b, b.seq AS since, b.kind AS since_kind,
      kind IN (2, 3) AND b.seq = seq AND b.kind = kind AS opened,
      kind NOT IN (2, 3) AND births > 0 AND NOT gone_before AS was_live,
      b.qty - used + CASE WHEN kind = 4 AND births > 0 THEN qty ELSE 0 END AS had,
      births > 0 AND NOT gone AND NOT gone_before AS is_live, b.qty - used AS left,
      births > 0 AND NOT gone_before AND (kind <= 1 OR NOT gone) AS is_open,
      gone_before AND max(gone_before AND kind IN (2, 3)) OVER
        (PARTITION BY period, part, id, seg, life ORDER BY seq, kind ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS again
    FROM x
"""


def lives(changes: DataFrame, hot_rows: int = HOT_ROWS, seq_block: int = SEQ_BLOCK) -> DataFrame:
    """``changes`` (see ``order_changes``; a message at most once per sequence number) with ``b``, what
    opened the order they met, ``opened`` (a birth that took effect), ``was_live`` (there was an order for an end or
    reduction), ``had`` (its shares just before), ``is_live`` and ``left`` (after it) and ``is_last``."""
    block = None if hot_keys(changes, KEYS, hot_rows) is None else seq_block
    return settle(changes, lambda rows: _evaluate(rows, block))


def _evaluate(rows: DataFrame, block: int | None) -> DataFrame:
    spark = rows.sparkSession
    todo, done = segments(rows, block), None
    while True:
        got = materialize(spark.sql(_LIVES, rows=todo), "lives")
        part = got.where("NOT again").drop("again")
        done = part if done is None else done.unionByName(part)
        again = got.where("again")
        if again.isEmpty():
            return done
        # what came after reductions used the order up lives again
        todo = again.selectExpr("period", "part", "id", "seq", "kind", "qty", "m", "life + 1 AS life", "is_last", "seg")


def sides(lived: DataFrame) -> DataFrame:
    """``period``, ``opened_at`` and ``side`` of the orders that replacements opened."""
    spark = lived.sparkSession
    ends = lived.where("kind = 1 AND was_live").selectExpr("period", "seq AS opened_at", "b.kind = 2 AS is_root", "b.seq AS parent", "b.side AS side")
    hops = materialize(ends, "replaced")
    done, active = hops.where("is_root").select("period", "opened_at", "side"), hops.where("NOT is_root").select("period", "opened_at", "parent")
    while not active.isEmpty():
        step = materialize(
            spark.sql(
                """
                SELECT a.period, a.opened_at, t.parent, t.side FROM {active} a
                JOIN (SELECT period, opened_at, parent, CAST(NULL AS STRING) AS side FROM {active} UNION ALL SELECT period, opened_at, NULL, side FROM {done}) t
                ON a.period = t.period AND a.parent = t.opened_at
                """,
                active=active,
                done=done,
            ),
            "sides",
        )
        done = done.unionByName(step.where("side IS NOT NULL").select("period", "opened_at", "side"))
        active = step.where("side IS NULL").select("period", "opened_at", "parent")
    return done


def with_sides(rows: DataFrame, lived: DataFrame) -> DataFrame:
    """``rows`` of ``lived`` with the ``side`` of the order each met."""
    own = rows.where("b.kind = 2").withColumn("side", F.col("b.side"))
    known = sides(lived).withColumnRenamed("period", "__p")
    other = rows.where("b.kind = 3").join(known, (F.col("period") == F.col("__p")) & (F.col("b.seq") == F.col("opened_at")))
    return own.unionByName(other.select(*own.columns))


_WHERE = [f"nullif(period, {NO_DATE}) AS session_date", f"nullif(part, {NO_LOCATE}) AS stock_locate"]


def _started(rows: DataFrame, first: DataFrame) -> DataFrame:
    return rows.join(first.select("period", "part", "start"), ["period", "part"]).where("seq >= start").drop("start")


def _lived(rows: DataFrame, universe: Collection[str] | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows by key, the books' starts and the lives of their orders. The rows are read many times, so
    they are written once, with the columns of a book, instead of being decoded each time."""
    k = materialize(keyed(rows), "book")
    first = starts(k, universe)
    return k, first, lives(order_changes(_started(k.where(F.col("message_type").isin(*"AFECXDU")), first)))


def _names(k: DataFrame, first: DataFrame) -> DataFrame:
    """The symbol of each book, or else what its day's directory says."""
    told = k.where("message_type = 'R'").groupBy("period", "part").agg(F.max_by("stock", "seq").alias("told"))
    return first.join(told, ["period", "part"], "left").selectExpr("period", "part", "coalesce(nullif(symbol, ''), told, '') AS symbol")


def tape(rows: DataFrame, universe: Collection[str] | None = None) -> DataFrame:
    """Executions of live orders, C of any once its book began, and P and Q of all."""
    k, first, lived = _lived(rows, universe)
    met = with_sides(lived.where("kind = 4 AND was_live AND m.message_type IN ('E', 'C')"), lived).selectExpr(
        "period", "part", "seq", "m.ts_ns AS ts_ns", "m.message_type AS message_type", "side", "m.shares AS shares", "CASE WHEN m.message_type = 'E' THEN b.price ELSE m.said_price END AS price",
        "m.match_number AS match_number", "m.printable AS printable",
    )
    # C trades whatever it names; without a live order it has no side
    missed = _started(k.where("message_type = 'C'"), first).join(met.where("message_type = 'C'").select("period", "part", "seq"), ["period", "part", "seq"], "left_anti")
    executed = met.unionByName(missed.select(*[c if c != "side" else F.lit(None).cast("string").alias(c) for c in met.columns])).join(_names(k, first), ["period", "part"])
    executed = executed.selectExpr(*_WHERE, "seq", "ts_ns", "symbol", "side", "shares", "price", "match_number", "message_type = 'E' OR coalesce(printable = 'Y', false) AS printable", "false AS is_cross", "CAST(NULL AS STRING) AS cross_type")
    q = "message_type = 'Q'"
    said = k.where("message_type IN ('P', 'Q')").selectExpr(
        "session_date", "stock_locate", "seq", "ts_ns", "coalesce(stock, '') AS symbol", f"CASE WHEN NOT {q} THEN side END AS side", "shares", "price", "match_number", "true AS printable", f"{q} AS is_cross", f"CASE WHEN {q} THEN cross_type END AS cross_type"
    )
    return executed.unionByName(said)


def deltas(rows: DataFrame, universe: Collection[str] | None = None) -> DataFrame:
    """Every change of a level's shares and orders; taking nothing off an order changes nothing."""
    _, _, lived = _lived(rows, universe)
    moved = with_sides(lived.where("opened OR was_live"), lived).selectExpr(
        *_WHERE, "seq", "m.ts_ns AS ts_ns", "side", "b.price AS price",
        "CASE WHEN opened THEN qty WHEN kind = 4 THEN -least(qty, had) ELSE -had END AS d_shares", "CAST(CASE WHEN opened THEN 1 WHEN kind < 4 OR qty >= had THEN -1 ELSE 0 END AS INT) AS d_orders",
    )
    return moved.where("d_shares <> 0 OR d_orders <> 0")


def live_orders(rows: DataFrame, universe: Collection[str] | None = None) -> DataFrame:
    """What is live at the end, with the place and time of the message that opened it."""
    k, first, lived = _lived(rows, universe)
    open_ = with_sides(lived.where("is_last AND is_live"), lived).join(_names(k, first), ["period", "part"])
    return open_.selectExpr(*_WHERE, "b.seq AS seq", "b.ts_ns AS ts_ns", "symbol", "id AS order_reference_number", "side", "left AS shares", "b.price AS price")
