"""A stream gives what the batch gives."""

import time

from pyspark.sql import functions as F

from tests.test_market import COLS, NAMES, feed
from tests.test_wire import S, body, pre
from tidebook.operators import analytics as an
from tidebook.operators import book as bk
from tidebook.operators import messages as ms
from tidebook.sources.feed import register
from tidebook.streaming import folds


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def run(stream, spark, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).outputMode("append").start()
    q.awaitTermination()
    return spark.table(name)


def parts(spark, tmp_path, messages, n=3):
    """The feed as files that a file stream takes one a batch, in order."""
    size = -(-len(messages) // n)
    for i in range(n):
        data = [tuple((m | {"seq": k, "ts_ns": k * 1000})[c] for c in NAMES) for k, m in list(enumerate(messages))[i * size : (i + 1) * size]]
        spark.createDataFrame(data, COLS).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    return spark.readStream.schema(COLS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), spark.read.parquet(str(tmp_path / "in"))


def test_books_and_bars(spark, tmp_path):
    stream, batch = parts(spark, tmp_path, feed(5, 300))
    assert rows(run(folds.stream_books(stream, "bbo"), spark, tmp_path, "bbo")) == rows(bk.rebuild(batch, "bbo"))
    assert rows(run(folds.stream_books(stream, "trades"), spark, tmp_path, "trades")) == rows(bk.rebuild(batch, "trades"))
    trades = bk.rebuild(batch, "trades").drop("session_date").cache()
    plain = stream.where("message_type = 'P'").select("session_date", "stock_locate", "seq", "ts_ns", "price", "shares")
    p = batch.where("message_type = 'P'").select("session_date", "stock_locate", "seq", "ts_ns", "price", "shares")
    got = run(folds.stream_bars(plain, "tick", 3), spark, tmp_path, "bars").select("stock_locate", "bar", "open", "high", "low", "close", "volume")
    want = an.bars(an.with_tick_bucket(p, 3, ["stock_locate"], 64), ["stock_locate"], 64)
    last = want.groupBy("stock_locate").agg(F.max("bar").alias("bar"))
    assert trades.count() and rows(got) == rows(want.join(last, ["stock_locate", "bar"], "left_anti").select(*got.columns))


def test_gaps_and_requests(spark, tmp_path):
    p = [("S", 0, 1, 2), ("S", 1, 5, 1), ("S", 2, 5, 1), ("T", 3, 9, 1), ("S", 4, 2, 6)]
    spark.createDataFrame(p, "session string, packet long, first_seq long, msg_count long").coalesce(1).write.parquet(str(tmp_path / "p"))
    stream = spark.readStream.schema("session string, packet long, first_seq long, msg_count long").parquet(str(tmp_path / "p"))
    batch = an.sequence_gaps(spark.read.parquet(str(tmp_path / "p")))
    assert rows(run(folds.stream_gaps(stream), spark, tmp_path, "gaps")) == rows(batch)
    asked = []
    folds.request_missing(folds.stream_gaps(stream), lambda *a: asked.append(a), str(tmp_path / "ask")).awaitTermination()
    assert asked == [("S", 3, 2)]


def test_growing_file(spark, tmp_path):
    register(spark)
    path = tmp_path / "live.bin"
    path.write_bytes(pre(S("O")) + b"\0\0" + pre(S("Q")) + pre(body("D", order_reference_number=1))[:7])
    stream = spark.readStream.format("tidefeed").option("path", str(path)).load()
    out = lambda: stream.writeStream.format("parquet").option("path", str(tmp_path / "o")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    out()
    assert spark.read.parquet(str(tmp_path / "o")).count() == 2
    with path.open("ab") as f:
        f.write(pre(body("D", order_reference_number=1))[7:] + pre(S("C")))
    out()
    got = spark.read.parquet(str(tmp_path / "o")).orderBy("seq").collect()
    assert [r.message_type for r in got] == ["S", "S", "D", "S"] and [r.seq for r in got] == [0, 16, 30, 51]


def test_replay(spark, tmp_path):
    register(spark)
    path = tmp_path / "r.bin"
    path.write_bytes(b"".join(pre(body("D", ts=int(t * 1e9), order_reference_number=i)) for i, t in enumerate((100, 100.5, 99, 101, 4000))))
    s = spark.readStream.format("tidereplay").option("path", str(path)).option("speed", "2").load()
    q = s.writeStream.format("memory").queryName("replayed").option("checkpointLocation", str(tmp_path / "rc")).start()
    try:
        q.processAllAvailable()
        deadline = time.time() + 25
        while time.time() < deadline and spark.table("replayed").count() < 4:
            time.sleep(0.5)
        assert spark.table("replayed").count() == 4  # the last is due in half an hour
    finally:
        q.stop()
    at_once = spark.readStream.format("tidereplay").option("path", str(path)).option("speed", "0").load()
    q = at_once.writeStream.format("memory").queryName("at_once").option("checkpointLocation", str(tmp_path / "rc0")).start()
    try:
        q.processAllAvailable()
        wide = ms.wide(spark.table("at_once"))
        assert [r.order_reference_number for r in wide.orderBy("seq").collect()] == [0, 1, 2, 3, 4]
    finally:
        q.stop()
