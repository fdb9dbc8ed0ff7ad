import random

import pytest

from tidebook.llm.nearest import nearest

LEFT, RIGHT = "tid long, day string, loc int, t long, bid long", "bid long, day string, loc int, t long, extra string"


def brute(left, right, tol):
    out = []
    for tid, day, loc, t, b in left:
        c = [(abs(rt - t), rt, rid) for rid, rd, rl, rt, _ in right if None not in (day, loc, t, rid, rd, rl, rt) and (rd, rl) == (day, loc) and abs(rt - t) <= tol]
        d = min(c) if c else (None, None, None)
        out.append((tid, day, loc, t, b, d[2], d[1]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "span", "tol"), [(1, 400, 10), (2, 60, 10), (3, 5000, 37), (4, 50, 0)])
def test_against_brute_force(spark, seed, span, tol):
    rnd = random.Random(seed)
    maybe = lambda x: None if rnd.random() < 0.03 else x
    key = lambda: (maybe(rnd.choice("ab")), maybe(1 if rnd.random() < 0.7 else rnd.randrange(4)), maybe(rnd.randrange(-span, span)))
    left = [(i, *key(), 5) for i in range(150)]
    right = [(rnd.choice([i, None]) if rnd.random() < 0.05 else i, *key(), "x") for i in range(200)]
    left += left[:10]
    right += right[:20]
    got = nearest(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), ["day", "loc"], "t", "bid", tol)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(left, right, tol)


def test_empty_sides(spark):
    left, right = spark.createDataFrame([(1, "a", 1, 5, 0)], LEFT), spark.createDataFrame([], RIGHT)
    assert [tuple(r)[-2:] for r in nearest(left, right, ["day", "loc"], "t", "bid", 5).collect()] == [(None, None)]
    assert nearest(left.limit(0), right, ["day", "loc"], "t", "bid", 5).count() == 0
