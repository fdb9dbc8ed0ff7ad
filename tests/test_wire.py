"""Decoding, encoding, framing and the data source, on bytes built by the encoder."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from tidebook import cli
from tidebook.functions import codes, scalars, wire
from tidebook.functions.layout import DEFAULT, Venue
from tidebook.operators import messages as ms
from tidebook.sources import export
from tidebook.sources import framing as fr
from tidebook.sources import feed as fd
from tidebook.sources.feed import FeedReader, diagnostics, read_frames, read_messages, split_faults, synced, write_stream


def body(code, locate=1, tracking=2, ts=1_651_500_000, **values):
    t = DEFAULT.types[code]
    given = {"message_type": code, "stock_locate": locate, "tracking_number": tracking, "ts_ns": ts} | values
    out = b""
    for f in t.fields:
        v = given.get(f.name, "" if f.kind == "a" else 0)
        out += v.encode("latin-1").ljust(f.size)[: f.size] if f.kind == "a" else int(v).to_bytes(f.size, "big")
    return out


def pre(b):
    return len(b).to_bytes(2, "big") + b


def S(event="O", locate=1):
    return body("S", locate, event_code=event)


ADD = dict(order_reference_number=42, buy_sell_indicator="B", shares=500, stock="AAPL", price=1_500_000)


# layout ----------------------------------------------------------------------------------------

def test_registry():
    # fixed values: wire sizes in registry order
    sizes = dict(zip("SRHYLVWKJhAFECXDUPQBINO", [12, 39, 25, 20, 26, 35, 12, 28, 35, 21, 36, 40, 31, 36, 23, 19, 35, 44, 40, 19, 50, 20, 48]))
    assert {c: t.wire_size for c, t in DEFAULT.types.items()} == sizes and list(DEFAULT.types) == list(sizes)
    assert DEFAULT.types["V"].price_precision == 8 and DEFAULT.types["A"].price_precision == 4
    assert [DEFAULT.types[c].category for c in "AFECXDUPQBS"] == ["add"] * 2 + ["modify"] * 5 + ["trade"] * 3 + ["other"]
    assert Venue("tiny", "S Only: event_code a1").size_of("S") == 12


def test_round_trip_of_all_types(spark):
    rnd = random.Random(4)
    value = lambda f: "".join(rnd.choice("ABCxyz ") for _ in range(f.size)).rstrip() or "Q" if f.kind == "a" else rnd.choice([0, 1, 256 ** min(f.size, 7) - 1, rnd.randrange(256 ** min(f.size, 7))])
    sent = [(i, t.code, {f.name: value(f) for f in t.body}) for i, t in enumerate(list(DEFAULT.types.values()) * 4)]
    raw = [(i, c, body(c, i, i, (1 << 48) - 1 - i, **v)) for i, c, v in sent]
    frames = spark.createDataFrame(raw, "seq long, message_type string, body binary").cache()
    wide = ms.wide(frames).cache()
    plain = lambda v: v.rstrip() if isinstance(v, str) and len(v) > 1 else v
    for r, (i, c, v) in zip(wide.orderBy("seq").collect(), sent):
        assert (r.stock_locate, r.tracking_number, r.ts_ns) == (i, i, (1 << 48) - 1 - i)
        assert {k: r[k] for k in v} == {k: plain(x) for k, x in v.items()}
        assert all(r[k] is None for k in set(wide.columns) - set(v) - {"seq", "message_type", "stock_locate", "tracking_number", "ts_ns"})
    for c in DEFAULT.types:
        one = ms.decode(frames, c)
        assert one.columns == ["seq", "message_type", *[f.name for f in DEFAULT.types[c].fields[1:]]]
    assert ms.decode(frames, "O").count() == 4
    assert [bytes(r.body) for r in ms.encode(wide).orderBy("seq").collect()] == [b for _, _, b in raw]
    assert all(r[0] and "  Timestamp: " in r[0] for r in wide.select(ms.text_of(wide)).collect())


def test_unsigned_64_bits(spark):
    b = body("D", order_reference_number=(1 << 64) - 1)
    r = spark.createDataFrame([(b,)], "body binary").select(wire.uint(F.col("body"), 11, 8).alias("s"), wire.uint_decimal(F.col("body"), 11).alias("d"), wire.uint(F.col("body"), 15, 8).alias("short")).first()
    assert (r.s, int(r.d), r.short) == (-1, (1 << 64) - 1, None)


def test_text_and_create(spark):
    m = ms.create_message(spark, "A", **ADD, ts_ns=1000)
    assert bytes(m.first().body) == body("A", 0, 0, 1000, **ADD)
    assert m.select(ms.text_of(m)).first()[0] == "Add Order:\n  Timestamp: 1000\n  Stock: AAPL\n  Side: B\n  Shares: 500\n  Price: 150"
    assert ms.scaled(m).first().price == 150.0
    for bad in (("?", {}), ("A", {"nothing": 1})):
        with pytest.raises(ValueError):
            ms.create_message(spark, bad[0], **bad[1])


@pytest.mark.parametrize(("x", "text"), [(150.0, "150"), (150.1234, "150.123"), (0.0001, "0.0001"), (0.0, "0"), (123456.7, "123457"), (1234567.0, "1.23457e+06"), (0.5, "0.5"), (429496.7295, "429497"), (99999.95, "100000")])
def test_short_double(spark, x, text):
    assert spark.range(1).select(ms.short_double(F.lit(x))).first()[0] == text


def test_scalars(spark):
    r = spark.sql("select 1500000L p, 15000000000L v, 34200000000000L t, date'2020-01-30' d, 90000000000000L late").select(
        scalars.price_text(F.col("p")).alias("a"), scalars.price_text(F.col("v"), 8).alias("b"), scalars.time_text(F.col("t")).alias("c"), scalars.moment_text(F.col("d"), F.col("t")).alias("e"),
        scalars.time_text(F.col("late")).alias("f"), scalars.moment_text(F.col("d"), F.col("late")).alias("g"), scalars.moment(F.col("d"), F.col("t")).cast("string").alias("h"),
        scalars.make_price(F.lit(150.0)).alias("i"), scalars.join_timestamp(*scalars.split_timestamp(F.col("t"))).alias("j"), scalars.time_text(F.lit(None).cast("long")).alias("k"),
    ).first()
    assert list(r) == ["150.0000", "150.00000000", "09:30:00.000000000", "2020-01-30 09:30:00.000000000", "25:00:00.000000000", "2020-01-31 01:00:00.000000000", "2020-01-30 09:30:00", 1_500_000, 34_200_000_000_000, None]


def test_codes(spark):
    r = spark.sql("select 'T12' a, '' b, '?' c, cast(null as string) n").select(
        codes.describe("TRADING_ACTION_REASON_CODES", F.col("a")).alias("a"), codes.describe("TRADING_ACTION_REASON_CODES", F.col("b")).alias("b"), codes.describe("MARKET_MAKER_MODE", F.col("c")).alias("c"),
        codes.cross_type_name(F.col("c")).alias("d"), codes.describe("MARKET_CATEGORY", F.col("n")).alias("n"),
    ).first()
    assert r.a.startswith("Trading Halted") and r.b == "Reason Not Available" and (r.c, r.d, r.n) == (None, "Unknown", None)
    assert codes.dimension(spark, "TRADING_STATES").count() == 4 and len(codes.TABLES) == 13


# framing ---------------------------------------------------------------------------------------

def errors(data):
    return [(c, e) for c, _, e in fr.frames(data)]


def test_framing_cases():
    s = pre(S())
    assert errors(s + b"\0\0" + pre(S("C", 4))) == [("S", None)] * 2
    assert errors(s + pre(b"?\0\0\0") + s) == [("S", None), ("?", "unknown_type"), ("S", None)]
    assert errors(pre(S()[:5]) + s) == [("S", "size_mismatch"), ("S", None)]
    assert errors(s + b"\0\x0c" + S()[:4]) == [("S", None), (None, "truncated")]
    assert errors(b"\0") == [(None, "truncated")] and errors(b"") == []
    long = body("R") + b"xx"
    assert errors(pre(long)) == [("R", None)]
    assert [c for c, _, _ in fr.iterator_frames(s + pre(S("C")) + s)] == ["S", "S"]
    with pytest.raises(ValueError):
        list(fr.iterator_frames(b"\0\1\0"))


def test_golden_stream():
    a = lambda n, ref, side, shares, price: body("A", n, 0, n, order_reference_number=ref, buy_sell_indicator=side, shares=shares, stock="AAPL", price=price)
    e = lambda n, ref, shares, match: body("E", n, 0, n, order_reference_number=ref, executed_shares=shares, match_number=match)
    s = lambda n, code: body("S", n, 0, n, event_code=code)
    rows = [s(1, "O"), a(2, 10, "B", 100, 5000), a(3, 11, "B", 200, 4900), s(4, "S"), a(5, 12, "S", 150, 5100), a(6, 13, "S", 50, 5200), e(7, 10, 40, 1), a(8, 14, "B", 300, 4800), e(9, 12, 150, 2), s(10, "C")]
    got = errors(b"".join(map(pre, rows)))
    assert "".join(c for c, _ in got) == "SAASAAEAES" and not any(x for _, x in got)


def mold(session, first, bodies, count=None):
    return session.encode().ljust(10) + struct.pack(">QH", first, len(bodies) if count is None else count) + b"".join(map(pre, bodies))


def test_mold():
    p = fr.mold_packet(mold("SESSION01", 1, [S("O"), S("S")]))
    assert (p.session, p.first, p.count, p.kind, len(p.frames)) == ("SESSION01", 1, 2, "data", 2)
    assert fr.mold_packet(mold("A", 9, [])).kind == "heartbeat" and fr.mold_packet(mold("A", 9, [], 0xFFFF)).kind == "end"
    assert fr.mold_packet(b"abcd") is None
    assert len(fr.mold_packet(mold("A", 1, [S()]) + b"\0\x0cS").frames) == 1


def test_soup_split_and_login():
    stream = pre(b"A" + b"GLIMPSE   " + b"42".rjust(20)) + pre(b"S" + S("O")) + pre(b"H") + pre(b"U" + S("Q")) + pre(b"S" + S("C"))
    for cut in range(len(stream)):
        soup = fr.SoupStream()
        got = soup.feed(stream[:cut]) + soup.feed(stream[cut:])
        assert [(p.kind, p.first, len(p.frames)) for p in got] == [("A", 42, 0), ("S", 42, 1), ("H", None, 0), ("U", None, 1), ("S", 43, 1)]
        assert soup.session == "GLIMPSE" and soup.next_sequence == 44


def udp(payload, port=26477, v6=False):
    u = struct.pack(">HHHH", 1, port, len(payload) + 8, 0) + payload
    return (b"\x60" + bytes(5) + b"\x11" + bytes(33) if v6 else b"\x45" + bytes(8) + b"\x11" + bytes(10)) + u


def ether(ip, vlans=0, v6=False):
    return bytes(12) + b"\x81\x00\x00\x01" * vlans + (b"\x86\xdd" if v6 else b"\x08\x00") + ip


def pcap(frames, link=1, order="<", magic=0xA1B2C3D4):
    return struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link) + b"".join(struct.pack(order + "IIII", 0, 0, len(f), len(f)) + f for f in frames)


def pcapng(frames, order="<", simple=False):
    block = lambda kind, data: struct.pack(order + "II", kind, len(data) + 12) + data + struct.pack(order + "I", len(data) + 12)
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack(order + "HHI", 1, 0, 0))
    for f in frames:
        pad = f + bytes(-len(f) % 4)
        out += block(3, struct.pack(order + "I", len(f)) + pad) if simple else block(6, struct.pack(order + "IIIII", 0, 0, 0, len(f), len(f)) + pad)
    return out + block(0x99, b"abcd")


@pytest.mark.parametrize(
    "data",
    [
        pcap([ether(udp(mold("S", 1, [S("O"), S("C")])))]), pcap([ether(udp(mold("S", 1, [S("O"), S("C")])))], order=">"), pcap([ether(udp(mold("S", 1, [S("O"), S("C")])), vlans=2)], magic=0xA1B23C4D),
        pcap([ether(udp(mold("S", 1, [S("O"), S("C")]), v6=True), v6=True)]), pcap([udp(mold("S", 1, [S("O"), S("C")]))], link=101), pcap([bytes(16) + udp(mold("S", 1, [S("O"), S("C")]))], link=113),
        pcapng([ether(udp(mold("S", 1, [S("O"), S("C")])))]), pcapng([ether(udp(mold("S", 1, [S("O"), S("C")])))], simple=True), pcapng([ether(udp(mold("S", 1, [S("O"), S("C")])))], order=">"),
    ],
)
def test_captures(data):
    got = [p for p in fr.Walk("auto").packets(data)]
    assert [f[1][11:12] for p in got for f in p.frames] == [b"O", b"C"]
    assert not list(fr.Walk("pcap", frozenset([9999])).packets(data))
    assert [p for p in fr.Walk("pcap").packets(data[:-40] if fr.capture_kind(data) == "pcap" else data[:60])] == []


def test_no_capture():
    assert fr.capture_kind(b"\x11" * 64) is None and fr.capture_kind(b"\n\r") is None
    assert fr.datagram(1, b"short") is None and fr.datagram(1, ether(b"\x45" + bytes(30))) is None and fr.datagram(7, bytes(60)) is None


# data source -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def day(tmp_path_factory):
    rnd = random.Random(2)
    path = tmp_path_factory.mktemp("feed") / "day.bin"
    out = [S("O")]
    for i in range(6000):
        code = rnd.choice("AFECXDUP")
        out.append(body(code, rnd.randrange(1, 4), 0, 10**9 + i, **{f.name: rnd.randrange(1, 60_000) if f.kind != "a" else "B" for f in DEFAULT.types[code].body}))
    out.append(S("C"))
    path.write_bytes(b"".join(map(pre, out)) + b"\0\0")
    return str(path), out


def test_source_reads_and_filters(spark, day):
    path, bodies = day
    df = read_frames(spark, path)
    assert [bytes(r.body) for r in df.orderBy("seq").collect()] == bodies
    assert ms.filter_types(df, ["A", "S"]).count() == sum(b[:1] in b"AS" for b in bodies)
    assert ms.filter_types(df, []).count() == 0
    assert ms.until_end(df).count() == len(bodies)
    total = {r.message_type: r.n for r in ms.histogram(df).collect()}
    assert total["TOTAL"] == len(bodies) and total["S"] == 2


def test_split_reading_gives_the_same_frames(spark, day):
    path, bodies = day
    df = read_frames(spark, path, framing="raw", splitBytes=20_000)
    rows = df.orderBy("seq").collect()
    assert df.rdd.getNumPartitions() > 5
    assert [bytes(r.body) for r in rows] == bodies
    assert [r.seq for r in rows[:2]] == [0, 14]


@pytest.mark.parametrize("odd", [1400, 3500])
def test_split_reading_keeps_frames_after_unknown_ones(tmp_path, odd):
    known, unknown = pre(S()), pre(b"?" + bytes(60))
    p = tmp_path / "odd.bin"
    p.write_bytes(known * 8000 + unknown * odd + known * 8000)
    options = {"path": str(p), "framing": "raw"}

    def read(o):
        x = FeedReader(o)
        return [(r["message_type"], r["body"], r["error"]) for part in x.partitions() for b in x.read(part) for r in b.to_pylist()]

    whole = read(options)
    assert len(whole) == 16_000 + odd and read(options | {"splitbytes": "50000"}) == whole


@pytest.mark.parametrize("size", [20, 10**9])
def test_what_needs_the_whole_file_is_not_split(spark, tmp_path, size):
    p = tmp_path / "a.bin"
    p.write_bytes(pre(S()) + pre(S("C")) + pre(S("Q")))
    assert read_frames(spark, str(p), splitBytes=size, stop_at_end=True).count() == 2
    assert [r.n_frames for r in read_frames(spark, str(p), splitBytes=size, emit="packets").collect()] == [3]


def test_ranges_meet(spark, day, tmp_path):
    path, bodies = day
    ranges = read_frames(spark, path, emit="ranges", splitBytes=20_000).collect()
    assert len(ranges) > 5 and split_count(spark, path) == 0
    assert ranges[0].first == 0 and sorted(r.after for r in ranges)[-1] == sum(len(b) + 2 for b in bodies) + 2


def split_count(spark, path):
    return split_faults(spark, path, splitBytes=20_000).count()


def test_pieces_of_any_size(spark, day, monkeypatch):
    """Frames, messages and seqs are the same however a file is cut into tasks and pieces."""
    path, bodies = day
    options = {"path": path, "framing": "raw", "emit": "messages"}
    rows = lambda o: [r for part in FeedReader(o).partitions() for b in FeedReader(o).read(part) for r in b.to_pylist()]
    whole = rows(options)
    assert len(whole) == len(bodies)
    for chunk, split in ((300, 10**9), (1000, 5000), (64, 777)):
        monkeypatch.setattr(fd, "CHUNK", chunk)
        assert rows(options | {"splitbytes": str(split)}) == whole


def test_decoded_in_the_source(spark, day):
    path, _ = day
    want = ms.wide(read_frames(spark, path, columns="seq,message_type,body")).orderBy("seq").collect()
    got = read_messages(spark, path, columns=["seq"]).orderBy("seq").collect()
    assert want[0].asDict().keys() == got[0].asDict().keys()
    assert [r.asDict() for r in got] == [r.asDict() for r in want]
    some = read_messages(spark, path, ["stock", "price"], ["seq"]).where("message_type = 'A'")
    assert some.columns == ["seq", "message_type", "stock", "price"] and some.count() == sum(b[:1] == b"A" for b in bodies_of(path))
    with pytest.raises(Exception, match="unknown fields"):
        read_messages(spark, path, ["nothing"]).count()


def test_unpacked_from_a_table(spark, day):
    path, bodies = day
    rows = [(i, b[:1].decode(), b, "x") for i, b in enumerate(bodies)] + [(-1, "A", None, "x"), (-2, None, S(), "x"), (-3, "A", b"", "x"), (-4, "Ax", S(), "x"), (-5, "A", bodies[1][:13], "x")]
    df = spark.createDataFrame(rows, "seq long, message_type string, body binary, stock string").drop("stock")
    want, got = ms.wide(df).orderBy("seq").collect(), ms.unpack(df).orderBy("seq").collect()
    assert [r.asDict() for r in got] == [r.asDict() for r in want]
    assert ms.unpack(df.repartition(3), ["price"]).columns == ["seq", "message_type", "price"] and ms.unpack(df.limit(0)).count() == 0


def bodies_of(path):
    with open(path, "rb") as f:
        return [b for _, b, _ in fr.frames(f.read())]


def test_latin_and_short_bodies(spark, tmp_path):
    p = tmp_path / "l.bin"
    p.write_bytes(pre(body("R", 7, stock="ABC", market_category="Q").replace(b"ABC ", b"A\xe9C ")) + pre(S()[:8]) + pre(b"\xf0" + bytes(20)))
    want = [r.asDict() for r in ms.wide(read_frames(spark, str(p), columns="seq,message_type,body")).orderBy("seq").collect()]
    got = [r.asDict() for r in read_messages(spark, str(p), columns=["seq"]).orderBy("seq").collect()]
    assert got == want and got[0]["stock"] == "A\xe9C" and got[2]["message_type"] == "\xf0"


def test_days_and_files(spark, tmp_path):
    for name, codes in (("01302020.part1", "OS"), ("01302020.part2", "QM"), ("01312020.part1", "EC")):
        (tmp_path / name).write_bytes(b"".join(pre(S(c)) for c in codes))
    df = read_frames(spark, str(tmp_path), date_format="%m%d%Y")
    rows = ms.wide(df).orderBy("session_date", "seq").collect()
    assert [(str(r.session_date), r.event_code) for r in rows] == [("2020-01-30", c) for c in "OSQM"] + [("2020-01-31", c) for c in "EC"]
    assert [r.seq % fd.FILE_ROOM for r in rows] == [0, 14] * 3 and len({(r.session_date, r.seq) for r in rows}) == 6
    assert {str(r.session_date) for r in read_frames(spark, str(tmp_path / "0131*"), session_date="2021-02-03").collect()} == {"2021-02-03"}
    assert {r.session_date for r in read_frames(spark, str(tmp_path / "0131*")).collect()} == {None}


def test_other_venue(spark, tmp_path):
    venue = Venue("tiny", "S SystemEvent: event_code a1\nZ Zap: size u4")
    (tmp_path / "z.bin").write_bytes(pre(S()) + pre(b"Z" + bytes(10) + (77).to_bytes(4, "big")) + pre(body("D", order_reference_number=1)))
    df = read_frames(spark, str(tmp_path / "z.bin"), venue=venue)
    assert sorted((r.message_type, r.error) for r in df.collect()) == [("D", "unknown_type"), ("S", None), ("Z", None)]
    assert ms.wide(df.where("error IS NULL"), venue).where("message_type = 'Z'").first().size == 77


def test_sync_finds_frame_starts(day):
    _, bodies = day
    data = b"".join(map(pre, bodies))
    starts, at = set(), 0
    for b in bodies:
        starts.add(at)
        at += 2 + len(b)
    for begin in range(1, 4000, 37):
        assert synced(data, begin) == min(s for s in starts if s >= begin)


def test_modes(spark, tmp_path):
    p = tmp_path / "bad.bin"
    p.write_bytes(pre(S()) + pre(b"?abc") + pre(S()[:5]) + pre(S("C")) + pre(S("Q")) + b"\0\x0cS")
    path = str(p)
    assert {r.error: r.n for r in diagnostics(read_frames(spark, path)).collect()} == {"ok": 3, "unknown_type": 1, "size_mismatch": 1, "truncated": 1}
    assert read_frames(spark, path, mode="dropmalformed").count() == 3
    assert read_frames(spark, path, mode="dropmalformed", stop_at_end=True).count() == 2
    for option in ({"mode": "failfast"}, {"unknown": "error"}):
        with pytest.raises(Exception, match="unknown_type"):
            read_frames(spark, path, **option).count()


def test_packets(spark, tmp_path):
    (tmp_path / "a.pcap").write_bytes(pcap([ether(udp(mold("S", 1, [S("O"), S("S")]))), ether(udp(mold("S", 5, [S("C")])))]))
    rows = read_frames(spark, str(tmp_path / "a.pcap"), emit="packets", dst_port=26477).orderBy("packet").collect()
    assert [(r.session, r.first_seq, r.msg_count, r.n_frames) for r in rows] == [("S", 1, 2, 2), ("S", 5, 1, 1)]
    assert read_frames(spark, str(tmp_path / "a.pcap"), dst_port=1).count() == 0
    (tmp_path / "s.bin").write_bytes(pre(b"A" + b"X".ljust(10) + b"7".rjust(20)) + pre(b"S" + S("Q")))
    assert [(r.session, r.packet_first) for r in read_frames(spark, str(tmp_path / "s.bin"), framing="soup").collect()] == [("X", 7)]


def test_write_stream(spark, day, tmp_path):
    path, bodies = day
    write_stream(ms.filter_types(read_frames(spark, path, splitBytes=20_000), ["E"]), str(tmp_path / "e"), parts=3)
    parts = sorted((tmp_path / "e").iterdir())
    assert len(parts) > 1 and not [p for p in parts if p.name.startswith(".")]
    assert [b for p in parts for _, b, _ in fr.frames(p.read_bytes())] == [b for b in bodies if b[:1] == b"E"]
    assert [bytes(r.body) for r in read_frames(spark, str(tmp_path / "e")).orderBy("seq").collect()] == [b for b in bodies if b[:1] == b"E"]
    write_stream(read_frames(spark, path).limit(0), str(tmp_path / "e"), mode="overwrite")
    assert read_frames(spark, str(tmp_path / "e")).count() == 0
    r = spark.createDataFrame([(S(),)], "body binary").select(ms.framed(F.col("body"))).first()[0]
    assert bytes(r) == pre(S())


# export ----------------------------------------------------------------------------------------

def test_csv_and_parquet(spark, tmp_path):
    bodies = [S(), body("A", 7, **ADD), body("R", 7, stock="A,B", market_category="Q"), body("U", 7, original_order_reference_number=42, new_order_reference_number=43, shares=1, price=5000), body("H", 7, stock="AAPL", trading_state="T")]
    m = ms.wide(spark.createDataFrame([(i, chr(b[0]), b) for i, b in enumerate(bodies)], "seq long, message_type string, body binary").coalesce(1))
    export.write_csv(m, str(tmp_path / "csv"))
    text = "".join(p.read_text() for p in (tmp_path / "csv").glob("*.csv")).splitlines()
    assert text[0] == ",".join(export.COLUMNS)
    assert text[1].endswith(",event=O") and "AAPL,42,B,500,150.0000,,," in text[2] and '"A,B"' in text[3] and text[3].endswith("category=Q")
    assert ",43,,1,0.5000,,,orig=42" in text[4] and text[5].startswith("H,") and "AAPL" not in text[5]
    export.write_parquet(m, str(tmp_path / "pq"))
    rows = {r.message_type: r for r in spark.read.parquet(str(tmp_path / "pq")).collect()}
    assert rows["A"].price == 150.0 and rows["S"].price is None and rows["S"].symbol == "" and rows["R"].extra == ""


def test_cli(spark, day, tmp_path, capsys):
    path, bodies = day
    assert cli.main(["stats", path], spark) == 0 and f"TOTAL {len(bodies)}" in capsys.readouterr().out
    assert cli.main(["inspect", path, "--limit", "2"], spark) == 0 and capsys.readouterr().out.startswith("System Event:")
    assert cli.main(["filter", path, "--types", "A,E", "--out", str(tmp_path / "o")], spark) == 0
    assert spark.read.csv(str(tmp_path / "o"), header=True).count() == sum(b[:1] in b"AE" for b in bodies)
    assert cli.main(["convert", path, "--to", "parquet", "--out", str(tmp_path / "p")], spark) == 0 and spark.read.parquet(str(tmp_path / "p")).count() == len(bodies)
    assert cli.main(["stats", str(tmp_path / "none")], spark) == 1
