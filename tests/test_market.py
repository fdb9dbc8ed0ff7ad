"""Books, tape, analytics and their streaming forms on hand-made and random feeds."""

import random

import pytest
from pyspark.sql import functions as F

from tidebook.operators import analytics as an
from tidebook.operators import book as bk
from tidebook.operators.legacy import Ladder, ladder

COLS = "session_date date, stock_locate int, seq long, ts_ns long, message_type string, stock string, order_reference_number long, original_order_reference_number long, new_order_reference_number long, buy_sell_indicator string, shares long, executed_shares long, cancelled_shares long, price long, execution_price long, cross_price long, match_number long, printable string, cross_type string"
NAMES = [c.split()[0] for c in COLS.split(", ")]


def msg(t, ref=None, side=None, shares=None, price=None, *, locate=1, stock="AAPL", new=None, match=None, printable=None, cross=None):
    m = dict.fromkeys(NAMES) | {"stock_locate": locate, "message_type": t, "match_number": match, "printable": printable, "cross_type": cross}
    m["stock"] = stock if t in "AFPQR" else None
    m["original_order_reference_number" if t == "U" else "order_reference_number"] = ref
    m["new_order_reference_number"], m["buy_sell_indicator"] = new, side
    m[{"E": "executed_shares", "C": "executed_shares", "X": "cancelled_shares"}.get(t, "shares")] = shares
    m[{"C": "execution_price", "Q": "cross_price"}.get(t, "price")] = price
    return m


def frame(spark, messages):
    rows = [tuple((m | {"seq": i, "ts_ns": i * 1000})[n] for n in NAMES) for i, m in enumerate(messages)]
    return spark.createDataFrame(rows, COLS)


def fold(messages, universe=None):
    """Straight through the fold, for many small cases."""
    f, tops, trades = bk.Fold(universe), [], []
    for i, m in enumerate(messages):
        u = m["message_type"] == "U"
        first = lambda *k: next((m[x] for x in k if m[x] is not None), None)  # noqa: B023, E731
        t, tr, _ = f.step((None, 1, i, i, m["message_type"], m["stock"], m["original_order_reference_number"] if u else m["order_reference_number"], m["new_order_reference_number"], m["buy_sell_indicator"], first("shares", "executed_shares", "cancelled_shares"), first("price", "execution_price", "cross_price"), m["match_number"], m["printable"], m["cross_type"]))
        tops += t
        trades += tr
    return f, tops, trades


def A(ref, side, shares, price, **k):
    return msg("A", ref, side, shares, price, **k)


# fixed cases -----------------------------------------------------------------------------------

def test_best_bid_and_ask():
    f, tops, _ = fold([A(1, "B", 100, 1500000), A(2, "B", 200, 1500100), A(3, "S", 50, 1500300), A(4, "S", 75, 1500200)])
    assert f.book.best() == (True, 1500100, 200, True, 1500200, 75) and len(tops) == 4


def test_clamped_execution_and_trade_shares():
    f, _, trades = fold([A(1, "S", 100, 2000000), msg("E", 1, shares=40, match=1), msg("E", 1, shares=999, match=2), msg("E", 1, shares=5, match=3)])
    assert not f.book.orders and [t[2] for t in trades] == [40, 999] and f.book.best() == bk.EMPTY


def test_reduce_delete_replace():
    f, *_ = fold([A(1, "B", 500, 10), msg("X", 1, shares=200)])
    assert f.book.orders[1][1] == 300
    f, *_ = fold([A(1, "B", 100, 1000000), msg("U", 1, new=2, shares=80, price=1000500)])
    assert list(f.book.orders) == [2] and f.book.best()[:3] == (True, 1000500, 80)
    f, *_ = fold([A(20, "B", 100, 6000), msg("U", 20, new=20, shares=150, price=6000)])
    assert f.book.levels[True] == {6000: [150, 1]}
    f, *_ = fold([A(1, "B", 9, 5), A(2, "B", 7, 6), msg("U", 1, new=2, shares=1, price=4), msg("U", 9, new=10, shares=1, price=4)])
    assert list(f.book.orders) == [2] and f.book.orders[2][1] == 7


def test_zero_share_orders():
    f, tops, _ = fold([A(1, "B", 0, 100)])
    assert tops == [(True, 100, 0, False, 0, 0)]
    f, tops, _ = fold([A(1, "B", 0, 100), msg("E", 1, shares=1)])
    assert tops[-1] == bk.EMPTY
    f, *_ = fold([A(1, "B", 5, 100), msg("E", 1, shares=0), A(1, "S", 9, 50)])
    assert f.book.orders[1][:3] == [True, 5, 100]


def test_tape_cases():
    _, _, trades = fold([msg("C", 9, shares=1, price=5, printable="Y"), A(10, "S", 100, 1500000), msg("E", 10, shares=40), msg("C", 10, shares=10, price=1499000, printable="N"), msg("C", 77, shares=3, price=8, printable="Y")])
    assert [(t[1], t[3], t[5]) for t in trades] == [("S", 1500000, True), ("S", 1499000, False), (None, 8, True)]


def test_universe():
    both = [msg("R"), A(1, "B", 1, 10), msg("P", 0, "B", 5, 11, stock="MSFT"), A(2, "B", 1, 12, stock="MSFT")]
    assert fold(both, {"AAPL"})[0].book.orders.keys() == {1, 2}  # a second symbol on a known locate enters
    f, _, trades = fold(both, {"GOOG"})
    assert f.book is None and len(trades) == 1 and f.symbol() == "AAPL"


def test_legacy_differences():
    k = Ladder("AAPL")
    for m in [("A", "AAPL", 1, None, "B", 10, 5), ("A", "AAPL", 1, None, "B", 7, 6), ("A", "MSFT", 2, None, "B", 7, 6), ("E", None, 1, None, None, 8, None)]:
        k.step(*m)
    assert k.levels == {("B", 5): [10, 1], ("B", 6): [(7 - 8) % 2**32, 1]}


# random feed -----------------------------------------------------------------------------------

def feed(seed, n=1500, refs=60):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        t = rnd.choice("AAAAFFEECXDUPQRIB")
        loc = rnd.choice([1, 1, 1, 2, 3])
        if t in "IB":
            continue
        out.append(msg(t, rnd.randrange(refs), rnd.choice("BS"), rnd.choice([0, 1, 5, 5, 100]), 100 * rnd.randrange(1, 15), locate=loc, stock=f"S{loc}", new=rnd.randrange(refs), match=i, printable=rnd.choice("YN"), cross="O"))
    return out


def naive(messages):
    """Orders in a list per locate; everything is recomputed at every message."""
    books, shown, tops, trades = {}, {}, [], []
    for i, m in enumerate(messages):
        loc, t, ref = m["stock_locate"], m["message_type"], m["original_order_reference_number"] if m["message_type"] == "U" else m["order_reference_number"]
        if t == "P":
            trades.append((i, m["price"], m["shares"]))
        if t == "Q":
            trades.append((i, m["cross_price"], m["shares"]))
        if t in "PQR" or (loc not in books and t not in "AF"):
            continue
        b = books.setdefault(loc, [])
        o = next((x for x in b if x[0] == ref), None)
        if t in "AF" and o is None:
            b.append([ref, m["buy_sell_indicator"], m["shares"], m["price"], i])
        if t == "C":
            trades.append((i, m["execution_price"], m["executed_shares"]))
        if t == "E" and o:
            trades.append((i, o[3], m["executed_shares"]))
        if o and t in "ECX":
            q = min(o[2], m["cancelled_shares"] if t == "X" else m["executed_shares"])
            if q == o[2]:
                b.remove(o)
            else:
                o[2] -= q
        if o and t in "DU":
            b.remove(o)
            if t == "U" and not any(x[0] == m["new_order_reference_number"] for x in b):
                b.append([m["new_order_reference_number"], o[1], m["shares"], m["price"], i])
        top = ()
        for side, pick in (("B", max), ("S", min)):
            prices = [x[3] for x in b if x[1] == side]
            top += (True, pick(prices), sum(x[2] for x in b if x[1] == side and x[3] == pick(prices))) if prices else (False, 0, 0)
        if top != shown.get(loc, bk.EMPTY):
            shown[loc] = top
            tops.append((loc, i, *top))
    return books, tops, trades


def test_rebuild_against_naive(spark):
    messages = feed(1)
    books, tops, trades = naive(messages)
    df = frame(spark, messages).repartition(5).cache()
    got = sorted(tuple(r)[1:3] + tuple(r)[4:] for r in bk.rebuild(df, "bbo").collect())
    assert got == sorted(tops)
    assert sorted((r.seq, r.price, r.shares) for r in bk.rebuild(df, "trades").collect()) == sorted(trades)
    orders = bk.rebuild(df, "orders").cache()
    assert sorted((r.stock_locate, r.order_reference_number, r.side, r.shares, r.price, r.seq) for r in orders.collect()) == sorted((loc, *o) for loc, b in books.items() for o in b)
    d = bk.rebuild(df, "deltas").groupBy("stock_locate", "side", "price").agg(F.sum("d_shares").alias("s"), F.sum("d_orders").alias("n")).where("n > 0")
    depth = bk.levels(orders)
    assert sorted(map(tuple, d.collect())) == sorted((r.stock_locate, r.side, r.price, r.shares, r.order_count) for r in depth.collect())
    last = {t[0]: t[2:] for t in tops}
    assert {r.stock_locate: tuple(r)[2:] for r in bk.tops(orders).collect()} == {k: v for k, v in last.items() if v != bk.EMPTY}
    q = bk.queue(orders).where("position = 1").count()
    assert q == depth.count() and bk.levels(orders, 2).where("level > 2").count() == 0
    assert {r.symbol for r in bk.symbols(df).collect()} == {"S1", "S2", "S3"} == {r.symbol for r in bk.book_index(df).collect()}
    lines = [r.line for r in bk.ladder_text(depth.where("stock_locate = 1")).orderBy("line_no").collect()]
    asks, bids = [i for i, x in enumerate(lines) if "Ask" in x], [i for i, x in enumerate(lines) if "Bid" in x]
    assert lines[0] == lines[2] == lines[-1] == "=" * 42 and len(lines) == len(asks) + len(bids) + 5 and max(asks) + 2 == min(bids)
    assert bk.rebuild(df.limit(0), "bbo").count() == 0


def test_legacy_agrees_on_a_correct_feed(spark):
    ok = [A(100, "B", 1000, 5000), msg("E", 100, shares=250), msg("C", 100, shares=250, price=1), msg("U", 100, new=101, shares=500, price=5050), msg("X", 101, shares=200), A(5, "S", 7, 6000)]
    df = frame(spark, ok)
    assert sorted((r.side, r.price, r.shares, r.order_count) for r in ladder(df, "AAPL").collect()) == [("B", 5050, 300, 1), ("S", 6000, 7, 1)]
    assert sorted((r.side, r.price, r.shares, r.order_count) for r in bk.levels(bk.rebuild(df, "orders")).collect()) == [("B", 5050, 300, 1), ("S", 6000, 7, 1)]


def test_broken_trades(spark):
    df = frame(spark, [msg("P", 0, "B", 5, 10, match=1), msg("P", 0, "B", 5, 10, match=2), msg("B", match=2)])
    assert [r.match_number for r in bk.without_broken(bk.rebuild(df, "trades"), df).collect()] == [1]


# analytics -------------------------------------------------------------------------------------

def tape(spark, rows):
    return spark.createDataFrame([("A", i, *r) for i, r in enumerate(rows)], "symbol string, seq long, ts_ns long, price long, shares long")


def test_bars(spark):
    t = tape(spark, [(1, 100, 5), (5, 120, 3), (12, 90, 4), (3, 80, 1)])
    got = an.bars(an.with_time_bucket(t, 10), ["symbol"], 2).orderBy("bar").collect()
    assert [(r.bucket, r.open, r.high, r.low, r.close, r.volume, r.n_trades) for r in got] == [(0, 100, 120, 100, 120, 8, 2), (1, 90, 90, 90, 90, 4, 1), (0, 80, 80, 80, 80, 1, 1)]
    v = an.bars(an.with_volume_bucket(tape(spark, [(1, 1, 60), (2, 1, 50), (3, 1, 10)]), 100, ["symbol"], 2), ["symbol"], 2).orderBy("bar").collect()
    assert [r.volume for r in v] == [110, 10]
    k = an.bars(an.with_tick_bucket(tape(spark, [(i, i, 1) for i in range(7)]), 3, ["symbol"], 2), ["symbol"], 2).orderBy("bar").collect()
    assert [r.n_trades for r in k] == [3, 3, 1]
    assert an.bars(an.with_time_bucket(t, 10), [], 2).count() == 3  # the whole market as one builder


def test_averages(spark):
    r = an.vwap(tape(spark, [(1, 100, 10), (2, 200, 30)]), ["symbol"]).first()
    assert (r.vwap, r.volume) == (0.0175, 40)
    assert an.vwap(tape(spark, [(1, 100, 0)]), ["symbol"]).first().vwap is None
    assert [x.vwap for x in an.vwap_running(tape(spark, [(1, 100, 0), (2, 100, 10), (3, 200, 30)]), ["symbol"], 2).orderBy("seq").collect()] == [None, 0.01, 0.0175]
    assert an.twap(tape(spark, [(0, 10000, 1), (10, 30000, 1), (20, 30000, 1)]), ["symbol"], 2).first().twap == 2.0
    assert an.twap(tape(spark, [(5, 10000, 1), (5, 30000, 1)]), ["symbol"], 2).first().twap == 3.0
    assert an.twap(tape(spark, [(10, 10000, 1), (5, 30000, 1), (15, 1, 1)]), ["symbol"], 2).first().twap == 3.0  # a step back replaces price and time


def top(spark, rows):
    return spark.createDataFrame([(None, 1, i, *r) for i, r in enumerate(rows)], "session_date date, stock_locate int, seq long, has_bid boolean, bid_price long, bid_shares long, has_ask boolean, ask_price long, ask_shares long")


def test_microstructure(spark):
    r = top(spark, [(True, 1000000, 300, True, 1000200, 100)]).select(an.spread().alias("s"), an.mid_price().alias("m"), an.queue_imbalance().alias("q")).first()
    assert tuple(r) == (0.02, 100.01, 0.5)
    r = top(spark, [(True, 1000000, 300, False, 0, 0)]).select(an.spread().alias("s"), an.queue_imbalance().alias("q")).first()
    assert tuple(r) == (None, 1.0)
    assert top(spark, [(False, 0, 0, False, 0, 0)]).select(an.queue_imbalance()).first()[0] is None
    o = an.order_flow_imbalance(top(spark, [(True, 10, 100, True, 12, 7), (True, 10, 150, True, 12, 7), (False, 0, 0, True, 12, 7), (True, 10, 40, False, 0, 0)]), block=2).orderBy("seq").collect()
    assert [x.ofi for x in o] == [None, 50, -150, 40 + 0]


def test_depth(spark):
    orders = bk.rebuild(frame(spark, [A(i, "B", 100 * i, 1000 * i) for i in (1, 2, 3)]), "orders")
    lv = bk.levels(orders)
    assert an.depth_at(lv, 0).first().shares == 600 and an.depth_at(lv, 2).first().shares == 500


def test_auctions(spark):
    cols = "session_date date, stock_locate int, seq long, ts_ns long, message_type string, stock string, shares long, cross_price long, match_number long, cross_type string, paired_shares long, imbalance_shares long, imbalance_direction string, far_price long, near_price long, current_reference_price long, price_variation_indicator string"
    noii = lambda q, loc, paired: (None, loc, q, q, "I", "X", None, None, None, "C", paired, 1200, "S", 1, 2, 3, "L")
    cross = lambda q, loc: (None, loc, q, q, "Q", "X", 6200, 3000000, q, "O", *[None] * 7)
    rows = [cross(0, 7), noii(1, 7, 5000), noii(2, 8, 1), noii(3, 7, 6000), cross(4, 7), cross(5, 7), cross(6, 9)]
    got = an.auctions(spark.createDataFrame(rows, cols), block=2).orderBy("seq").collect()
    assert [(r.seq, r.paired_shares, r.has_imbalance) for r in got] == [(0, None, False), (4, 6000, True), (5, 6000, True), (6, None, False)]


def test_sequence(spark):
    p = [("S", 1, 2), ("S", 5, 1), ("S", 5, 1), ("S", 2, 6), ("T", 9, 0), ("T", 9, 1), ("S", 8, 1)]
    df = spark.createDataFrame([(s, i, f, c) for i, (s, f, c) in enumerate(p)], "session string, packet long, first_seq long, msg_count long")
    g = an.sequence_gaps(df, block=2)
    assert [(r.expected, r.missing, r.fresh) for r in g.orderBy("packet").collect()] == [(None, 0, 2), (3, 2, 1), (6, 0, 0), (6, 0, 2), (None, 0, 0), (9, 0, 1), (8, 0, 1)]
    assert {r.session: (r.expected_next, r.messages_seen, r.gap_count) for r in an.sequence_summary(g).collect()} == {"S": (9, 6, 2), "T": (10, 1, 0)}


def folded(rows, universe=None):
    """(trades, deltas, live orders) by taking one message after the other."""
    trades, deltas, live, folds = [], [], [], {}
    for m in sorted(rows, key=lambda r: r[2]):
        f = folds.setdefault(m[:2], bk.Fold(universe))
        _, t, d = f.step(m)
        trades += [(*m[:4], *x) for x in t]
        deltas += [(*m[:4], "B" if bid else "S", price, ds, dn) for bid, price, ds, dn in d]
    for key, f in folds.items():
        if f.book:
            live += [(*key, seq, ts, f.symbol(), ref, "B" if bid else "S", shares, price) for ref, (bid, shares, price, seq, ts) in f.book.orders.items()]
    return trades, deltas, live


@pytest.mark.parametrize("seed, hot_rows, universe", [(1, 10**9, {"AAA"}), (2, 20, None)])
def test_lives_of_orders_against_the_fold(spark, monkeypatch, seed, hot_rows, universe):
    """References used again, replaced in chains, onto live ones and onto themselves; several days, a null
    locate, books that begin late."""
    import datetime
    import random

    from tidebook.operators import orders as od

    monkeypatch.setattr(od.lives, "__defaults__", (hot_rows, 32))
    rnd = random.Random(seed)
    days, rows = [datetime.date(2020, 1, 30), datetime.date(2020, 1, 31), None], []
    for seq in range(600):
        t = rnd.choice("AAFEECXDUUPQR")
        few = 4 if seq % 5 else 60
        adds = t in "AFUPQ"
        rows.append((
            rnd.choice(days), rnd.choice([1, 1, 1, 2, None]), seq, seq * 7, t, rnd.choice(["AAA", "BBB"]) if t in "AFPQR" else None, rnd.randrange(few) if t not in "PQR" else None, rnd.randrange(few) if t == "U" else None,
            rnd.choice("BS") if t in "AFP" else None, rnd.choice([0, 1, 5, 9]) if t != "R" and t != "D" else None, rnd.randrange(100, 104) if adds or t == "C" else None, seq if t in "ECPQ" else None, rnd.choice("YN") if t == "C" else None, "O" if t == "Q" else None,
        ))
    schema = "session_date date, stock_locate int, seq long, ts_ns long, message_type string, stock string, ref long, new_ref long, side string, shares long, price long, match_number long, printable string, cross_type string"
    monkeypatch.setattr(bk, "book_rows", lambda m: m)
    df = spark.createDataFrame(rows, schema).repartition(3)
    for kind, want in zip(("trades", "deltas", "orders"), folded(rows, universe)):
        got = [tuple(r) for r in bk.rebuild(df, kind, universe).collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr), kind
    assert bk.rebuild(df.limit(0), "trades").count() == 0
