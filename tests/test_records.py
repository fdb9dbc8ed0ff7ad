"""The record operators against brute force: nulls, ties, repeats, empty tables, clashing names, hot keys."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidebook.operators import asof, carry, frequencies as fq, ordered, references as rf
from tidebook.operators import hot as ht, seen as sn
from tidebook.operators.seen import SeenBitmaps


def key(x):
    return repr(x)


# frequencies -----------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def skewed():
    rnd = random.Random(3)
    rows = []
    for _ in range(1500):
        k = "hot" if rnd.random() < 0.4 else rnd.choice(["a", "b", None, f"k{rnd.randrange(40)}"])
        rows.append((rnd.randrange(2), k, rnd.choice([None, 7, 7, -3, rnd.randrange(-(10**12), 10**12), rnd.randrange(50)]), "x"))
    return rows


def test_profile_and_percentiles(spark, skewed):
    df = spark.createDataFrame(skewed, "day int, k string, value long, __weight string")
    freq = fq.value_frequencies(df, ["day", "k"], "value")
    groups = defaultdict(list)
    for d, k, v, _ in skewed:
        groups[d, k].append(v)
    got = {(r.day, r.k): r for r in fq.key_profile(freq, ["day", "k"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        known = [v for v in vs if v is not None]
        best = min(Counter(known).items(), key=lambda x: (-x[1], x[0])) if known else (None, None)
        r = got[g]
        assert (r.n_rows, r.n_values, r.n_distinct, r["mode"], r.mode_rows) == (len(vs), len(known), len(set(known)), *best)
    probs = [0.0, 0.25, 0.5, 0.99, 1.0]
    want = {(*g, p): sorted(v for v in vs if v is not None)[max(1, math.ceil(p * sum(v is not None for v in vs))) - 1] for g, vs in groups.items() for p in probs if any(v is not None for v in vs)}
    assert {(r.day, r.k, r.p): r.percentile for r in fq.weighted_percentiles(freq, ["day", "k"], probs).collect()} == want


def test_heavy_keys(spark, skewed):
    df = spark.createDataFrame(skewed, "day int, k string, value long, x string")
    got = {(r.day, r.k) for r in fq.heavy_keys(fq.value_frequencies(df, ["day", "k"], "value"), ["day"], "k", 0.05).collect()}
    total = Counter(d for d, k, *_ in skewed if k is not None)
    assert got == {g for g, n in Counter((d, k) for d, k, *_ in skewed if k is not None).items() if n >= 0.05 * total[g[0]]}
    exact = spark.createDataFrame([(0, "a", 1)] * 1 + [(0, "b", 1)] * 19, "day int, k string, value long")
    assert {r.k for r in fq.heavy_keys(fq.value_frequencies(exact, ["day", "k"], "value"), ["day"], "k", 0.05).collect()} == {"a", "b"}


def test_frequencies_of_nothing(spark):
    df = spark.createDataFrame([], "k string, value long")
    freq = fq.value_frequencies(df, ["k"], "value")
    assert fq.key_profile(freq, ["k"]).count() == fq.weighted_percentiles(freq, ["k"], [0.5]).count() == 0


# carry and ordered -----------------------------------------------------------------------------

@pytest.fixture(scope="module")
def series():
    rnd = random.Random(8)
    return [(i, "hot" if rnd.random() < 0.5 else rnd.choice(["a", "b", None]), rnd.randrange(-60, 300), rnd.choice([None, rnd.randrange(100)]), rnd.randrange(3)) for i in range(500)]


@pytest.mark.parametrize("blocked", [False, True])
@pytest.mark.parametrize("how", ["strict", "peers", "priority"])
def test_carry_max(spark, series, blocked, how):
    df = spark.createDataFrame(series, "i int, e string, o long, v long, prio int")
    block = F.floor(F.col("o") / 50) if blocked else None
    got = {r.i: r.v for r in carry.carry_max(df, ["e"], "o", ["v"], strict=how == "strict", priority="prio" if how == "priority" else None, block=block).collect()}
    before = {"strict": lambda a, b: a[2] < b[2], "peers": lambda a, b: a[2] <= b[2], "priority": lambda a, b: (a[2], a[4]) <= (b[2], b[4])}[how]
    assert got == {r[0]: max([s[3] for s in series if s[1] == r[1] and s[3] is not None and before(s, r)], default=None) for r in series}


def test_prefix_previous_runs(spark, series):
    rows = [(i, e, i * 3, v, o % 2) for i, e, o, v, _ in series]
    df = spark.createDataFrame(rows, "i int, e string, o long, v long, b long")
    block = ordered.order_block("o", 128)
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    sums = {r.i: (r.inc, r.n) for r in ordered.prefix_sums(df, ["e"], ["o"], {"inc": F.col("v"), "n": F.lit(1)}, block).collect()}
    ex = {r.i: r.inc for r in ordered.prefix_sums(df, ["e"], ["o"], {"inc": F.col("v")}, block, inclusive=False).collect()}
    prev = {r.i: r.prev and r.prev.v for r in ordered.previous(df, ["e"], "o", ["v"], block).collect()}
    want_runs = []
    for e, rs in by.items():
        total = 0
        for n, r in enumerate(rs):
            assert ex[r[0]] == total
            total += r[3] or 0
            assert sums[r[0]] == (total, n + 1)
            assert prev[r[0]] == (rs[n - 1][3] if n else None)
        k = -1
        for n, r in enumerate(rs):
            if n == 0 or rs[n - 1][4] != r[4]:
                k += 1
                want_runs.append([e, k, r[4], r[2], r[2], r[3], r[3], 0, 0])
            w = want_runs[-1]
            w[4], w[6] = r[2], r[3]
            w[7] += r[3] or 0
            w[8] += 1
    got = ordered.runs(df, ["e"], "o", "b", [("first", "first", F.col("v")), ("last", "last", F.col("v")), ("sum", "sum", F.coalesce("v", F.lit(0))), ("n", "count", F.lit(1))], block).collect()
    assert sorted(map(tuple, got), key=key) == sorted(map(tuple, want_runs), key=key)
    assert ordered.runs(df.limit(0), ["e"], "o", "b", [("n", "count", F.lit(1))], block).count() == 0


# attributes at event time ----------------------------------------------------------------------

def test_attributes_at(spark):
    rnd = random.Random(6)
    maybe = lambda x: None if rnd.random() < 0.05 else x
    events = [(i, maybe(rnd.choice(["hot", "hot", "b"])), maybe(rnd.randrange(200)), "x") for i in range(200)]
    changes = {n: [(j, maybe(rnd.choice(["hot", "b"])), maybe(rnd.randrange(200)), maybe(rnd.randrange(220)), j // 2, f"{n}{j}") for j in range(60)] for n in ("p", "q")}
    changes["p"] += changes["p"][:10]
    dfs = {n: spark.createDataFrame(c, "id int, e string, t long, known long, ver int, val string") for n, c in changes.items()}
    got = asof.attributes_at(spark.createDataFrame(events + events[:5], "i int, e string, t long, val string"), dfs, ["e"], "t", holds_from="t", known_from="known", version=["ver", "id"], payload="val", block_ns=16).collect()
    assert len(got) == 205
    for r in got:
        for n in ("p", "q"):
            fit = [(c[2], c[4], c[0], c[5]) for c in changes[n] if None not in (c[1], c[2], c[3], r.e, r.t) and c[1] == r.e and c[2] <= r.t and c[3] <= r.t]
            assert (r[n] and r[n].val) == (max(fit)[3] if fit else None)


def test_change_at_the_same_time_counts_and_late_knowledge_does_not(spark):
    ev = spark.createDataFrame([(1, "e", 10)], "i int, e string, t long")
    ch = spark.createDataFrame([("e", 10, 10, 1, "now"), ("e", 11, 9, 2, "early"), ("e", 5, 11, 3, "late")], "e string, t long, known long, ver int, val string")
    r = asof.attributes_at(ev, {"a": ch}, ["e"], "t", holds_from="t", known_from="known", version=["ver"], payload="val").first()
    assert r.a.val == "now"
    assert asof.attributes_at(ev, {"a": ch.limit(0)}, ["e"], "t", holds_from="t", known_from="known", version=["ver"], payload="val").first().a is None


# references ------------------------------------------------------------------------------------

@pytest.mark.parametrize("match", ["simple", "partial", "full"])
def test_missing_references(spark, match):
    rnd = random.Random(match)
    maybe = lambda x: None if rnd.random() < 0.25 else x
    refs = [(i, maybe(rnd.randrange(3)), maybe(rnd.randrange(4))) for i in range(120)]
    targets = [(maybe(rnd.randrange(3)), maybe(rnd.randrange(3)), "z") for _ in range(8)] * 2

    def missing(a, b):
        if a is None and b is None:
            return False
        if a is None or b is None:
            if match != "partial":
                return match == "full"
        return not any((a is None or a == x) and (b is None or b == y) for x, y, _ in targets)

    got = rf.missing_references(spark.createDataFrame(refs + refs[:3], "i int, a int, b int"), spark.createDataFrame(targets, "a int, b int, i string"), ["a", "b"], match=match)
    assert sorted(r.i for r in got.collect()) == sorted(i for i, a, b in refs + refs[:3] if missing(a, b))


def test_missing_without_targets(spark):
    refs = spark.createDataFrame([(1, 5), (2, None)], "i int, a int")
    none = refs.limit(0)
    assert [r.i for r in rf.missing_references(refs, none, ["a"]).collect()] == [1] and rf.missing_references(none, refs, ["a"]).count() == 0
    with pytest.raises(ValueError):
        rf.missing_references(refs, refs, ["a"], match="odd")


@pytest.mark.parametrize("hot_rows", [10**9, 10])
def test_orphans_in_time(spark, hot_rows):
    rnd = random.Random(hot_rows)
    maybe = lambda x, p=0.05: None if rnd.random() < p else x
    rows = []
    for i in range(600):
        q = rnd.randrange(400)
        kind = rnd.choice(["ref", "born", "end", "refend"])
        rows.append((i, maybe("d"), maybe(rnd.randrange(2)), maybe(1 if rnd.random() < 0.4 else rnd.randrange(12)), maybe(q, 0.02), "ref" in kind, q if kind == "born" else None, q if "end" in kind else None))

    def orphan(r):
        i, d, loc, ref, q, is_ref, _, _ = r
        if not is_ref or ref is None or q is None:
            return False
        same = [s for s in rows if s[3] == ref and s[4] is not None and (d is None or s[1] == d) and (loc is None or s[2] == loc)]
        if d is None:
            return not any(s[6] is not None for s in same)
        b = max([s[6] for s in same if s[6] is not None and s[4] < q], default=None)
        e = max([s[7] for s in same if s[7] is not None and s[4] < q], default=None)
        return b is None or (e is not None and e > b)

    df = spark.createDataFrame(rows, "i int, d string, loc int, ref long, q long, is_ref boolean, born long, ended long")
    got = rf.orphans_in_time(df, ["d", "loc", "ref"], "q", period=["d"], hot_rows=hot_rows, order_block=64)
    assert sorted(r.i for r in got.collect()) == sorted(r[0] for r in rows if orphan(r))
    assert rf.orphans_in_time(df.limit(0), ["d", "loc", "ref"], "q", period=["d"]).count() == 0


def test_hot_keys_are_exact(spark, monkeypatch):
    rows = [(i % 7 if i % 2 else 7, None if i % 50 == 0 else "x", i) for i in range(900)]
    df = spark.createDataFrame(rows, "k int, j string, v int")
    count = Counter((k, j) for k, j, _ in rows if j)
    for named in (1000, 0):
        monkeypatch.setattr(ht, "NAMED", named)
        hot = ht.hot_keys(df, ["k", "j"], 100)
        want = {k for k, n in count.items() if n > 100}
        assert hot.n == len(want) and {tuple(r) for r in hot.table.collect()} == want
        assert hot.of(df).count() == sum(count[k] for k in want) and hot.of(df).count() + hot.others(df).count() == len(rows)
    assert ht.hot_keys(df, ["k", "j"], 900) is None and ht.hot_keys(df.limit(0), ["k"], 0) is None


# delivered more than once ----------------------------------------------------------------------

def test_increments(spark, tmp_path, monkeypatch):
    rnd = random.Random(12)
    rows = [(i, rnd.choice(["s1", "s2", "s1 ", None]), rnd.choice([None, 1, 2, 40_000, -5, 0, 10**12, rnd.randrange(100)]), rnd.choice([None, i // 10, 3]), "x") for i in range(400)]
    schema = "row_id int, space string, no long, at int, bits string"
    keep = {}
    for r in rows:
        if r[1] is not None and r[2] is not None:
            k = (r[1].rstrip(), r[2])
            keep[k] = min(keep.get(k, (9,)), (r[3] is None, r[3] or 0, r[0]))
    drop = sorted(r[0] for r in rows if r[1] is not None and r[2] is not None and keep[r[1].rstrip(), r[2]][2] != r[0])
    space = F.rtrim("space")
    one = SeenBitmaps(spark, str(tmp_path / "one"))
    assert one.kept() is None and one.counts().count() == 0
    assert one.increment(spark.createDataFrame(rows, schema), space, "no", ["at"], "row_id") == 1
    assert sorted(r.row_id for r in one.dropped().collect()) == drop
    assert sorted(r.row_id for r in one.kept().collect()) == sorted({r[0] for r in rows} - set(drop))
    assert sorted(map(tuple, one.kept().unionByName(one.dropped()).collect()), key=repr) == sorted(rows, key=repr)
    assert {r.space: r.n_seen for r in one.counts().collect()} == Counter(k[0] for k in keep)
    # in parts, what an earlier part kept is dropped later
    monkeypatch.setattr(sn, "COMPACT", 3)
    many, seen = SeenBitmaps(spark, str(tmp_path / "many")), set()
    for part in (rows[:150], [], rows[150:260], rows[:20], rows[260:]):
        v = many.increment(spark.createDataFrame(part, schema), space, "no", ["at"], "row_id")
        kept = many.kept([v]).collect()
        new = {(r.space.rstrip(), r.no) for r in kept if r.space is not None and r.no is not None}
        assert not new & seen
        assert len(kept) + many.dropped([v]).count() == len(part)
        seen |= new
    assert seen == set(keep) and many.version() == 5
    assert {r.space: r.n_seen for r in many.counts().collect()} == Counter(k[0] for k in keep)
    ids = [r.space_id for r in many.dictionary().collect()]
    assert len(set(ids)) == len(ids) == 2


def test_touched_shards_only(spark, tmp_path):
    store = SeenBitmaps(spark, str(tmp_path / "s"))
    for part in ([(1, "a", 5), (2, "a", 40_000)], [(3, "a", 6), (4, "b", 5), (5, "a", 5)]):
        store.increment(spark.createDataFrame(part, "row_id int, space string, no long"), F.col("space"), "no", [], "row_id")
    second = store._marker(2)["folder"]
    assert spark.read.parquet(f"{tmp_path}/s/{second}/shards").count() == 2 and spark.read.parquet(f"{tmp_path}/s/{second}/dictionary").count() == 1
    assert [r.row_id for r in store.dropped([2]).collect()] == [5]


def test_increment_that_dies(spark, tmp_path, monkeypatch):
    """Before the marker nothing has happened; after it the increment is known by its name."""
    store = SeenBitmaps(spark, str(tmp_path / "s"))
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 5)], "row_id int, space string, no long")
    run = lambda: store.increment(rows, F.col("space"), "no", [], "row_id", name="monday")
    with monkeypatch.context() as m:
        m.setattr(SeenBitmaps, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            run()
    assert store.version() == 0 and store.kept() is None
    assert run() == 1 and run() == 1 and store.version() == 1
    assert [r.row_id for r in store.kept().collect()] == [1]


def test_two_writers(spark, tmp_path, monkeypatch):
    store, other = (SeenBitmaps(spark, str(tmp_path / "s")) for _ in range(2))
    row = lambda i: spark.createDataFrame([(i, "a", i)], "row_id int, space string, no long")
    store.increment(row(1), F.col("space"), "no", [], "row_id")
    real = SeenBitmaps._commit

    def late(self, version, marker):
        if self is store and not other_done:
            other_done.append(other.increment(row(2), F.col("space"), "no", [], "row_id"))
        real(self, version, marker)

    other_done: list = []
    monkeypatch.setattr(SeenBitmaps, "_commit", late)
    with pytest.raises(sn.Conflict):
        store.increment(row(3), F.col("space"), "no", [], "row_id")
    assert other_done == [2] and store.version() == 2
    assert store.increment(row(3), F.col("space"), "no", [], "row_id") == 3
    assert sorted(r.row_id for r in store.kept().collect()) == [1, 2, 3] and store.counts().first().n_seen == 3
