import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import qdigest as q


def check(values, got, k):
    values = np.sort(np.array(values))
    for r in got:
        rank, v = max(1, math.ceil(r.p * len(values))), r.percentile
        below, upto = np.searchsorted(values, v, "left"), np.searchsorted(values, v, "right")
        bound = q.BITS * (len(values) // k)
        assert r.n == len(values) and r.max_rank_error == bound
        assert below + 1 - rank <= bound and rank - upto <= bound


@pytest.mark.parametrize("shape", ["uniform", "hot", "two", "wide"])
def test_rank_error_after_merges(spark, shape):
    rnd = random.Random(shape)
    draw = {"uniform": lambda: rnd.randrange(10**6), "hot": lambda: 7 if rnd.random() < 0.6 else rnd.randrange(2**31), "two": lambda: rnd.choice([0, 2**32 - 1]), "wide": lambda: int(2 ** (rnd.random() * 32))}[shape]
    rows = [(day, rnd.choice(["a", None]), draw()) for day in range(4) for _ in range(5000)]
    df = spark.createDataFrame(rows, "day int, g string, v long").repartition(7)
    eps = 0.1
    days = q.summarize(df, ["day", "g"], {"v": q.quantize(F.col("v"))}, eps)
    whole = q.merge(days, ["g"], eps)
    assert whole.count() < 2 * 3 * q.size_for(eps) + 100
    got = q.percentiles(whole, ["g"], [0.0, 0.01, 0.5, 0.9, 1.0], eps).collect()
    assert len(got) == 10
    for g in ("a", None):
        check([v for _, h, v in rows if h == g], [r for r in got if r.g == g], q.size_for(eps))


@pytest.mark.parametrize("fan_in, held", [(2, 40), (3, 1_000_000)])
def test_merges_in_levels(spark, monkeypatch, fan_in, held):
    monkeypatch.setattr(q, "FAN_IN", fan_in)
    monkeypatch.setattr(q, "HELD", held)
    rnd = random.Random(fan_in)
    rows = [(rnd.choice("aaab"), rnd.randrange(3000), rnd.choice([None, 5])) for _ in range(6000)]
    df = spark.createDataFrame(rows, "g string, v long, w long").repartition(9)
    whole = q.summarize(df, ["g"], {"v": q.quantize(F.col("v")), "w": q.quantize(F.col("w"))}, 0.1)
    got = q.percentiles(whole, ["g", "metric"], [0.1, 0.5, 0.9], 0.1).collect()
    for g in "ab":
        check([v for h, v, _ in rows if h == g], [r for r in got if r.g == g and r.metric == "v"], q.size_for(0.1))
        check([w for h, _, w in rows if h == g and w], [r for r in got if r.g == g and r.metric == "w"], q.size_for(0.1))


def test_counts_survive_folding():
    rng = np.random.default_rng(3)
    group, node = rng.integers(0, 5, 20_000), rng.integers(0, 2**20, 20_000)
    key = np.unique(group << 32 | node)
    g, lv, nd, ct = q.fold(key >> 32, np.zeros(len(key), np.int32), key & (2**32 - 1), np.full(len(key), 3), 50)
    assert ct.sum() == 3 * len(key) and len(ct) < 5 * 200
    assert len(np.unique((g << 40) | (lv.astype(np.int64) << 33) | nd)) == len(g)
    inner = ct[(lv > 0) & (lv < q.BITS)]
    assert inner.max() <= np.bincount(key >> 32).max() * 3 // 50


def test_nulls_nan_out_of_range_and_empty(spark):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("a", -5.0), ("a", 2.25), ("a", 1e30), ("b", None)], "g string, v double")
    got = q.percentiles(q.summarize(df, ["g"], {"v": q.quantize(F.col("v"), 0, 0.5)}, 0.01), ["g"], [0.01, 0.5, 1.0], 0.01, 0, 0.5).orderBy("p").collect()
    assert [(r.g, r.n, r.percentile) for r in got] == [("a", 4, 0.0), ("a", 4, 2.0), ("a", 4, (2**32 - 1) * 0.5)]
    assert q.summarize(df.limit(0), ["g"], {"v": q.quantize(F.col("v"))}, 0.01).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([("a", 1, 5, "x"), ("a", 1, 9, "y")], "g string, n int, v long, p string")
    assert [r.percentile for r in q.percentiles(q.summarize(df, ["g"], {"v": q.quantize(F.col("v"))}, 0.1), ["g"], [1.0], 0.1).collect()] == [9]


def test_bound_says_something_at_the_tails(spark, tmp_path):
    from tidebook.llm import plans

    spark.range(6400).selectExpr("date'2020-01-30' AS session_date", "1 AS stock_locate", "id AS price", "id AS shares").write.parquet(str(tmp_path / "add_order.parquet"))
    for r in plans.p2_percentiles(spark, str(tmp_path)).collect():
        assert r.max_rank_error < min(r.p, 1 - r.p) * r.n / 5
