from collections import Counter, defaultdict

import numpy as np
import pytest

from tidebook.llm import mixing as m

TARGETS = "source string, target_share double, max_repeats int"
COUNTS = "doc_id long, source string, n_tokens long, block string"


@pytest.mark.parametrize("n", [1, 2, 3, 5, 64, 1000, 4097])
def test_permutation(n):
    for key in (0, 12345, 2**40 + 1):
        p = m.permute(np.arange(n), n, key)
        assert sorted(p) == list(range(n))
    assert n < 64 or (m.permute(np.arange(n), n, 1) != m.permute(np.arange(n), n, 2)).any()


def test_draws_meet_quotas():
    quota = [9000, 500, 1, 70_000]
    got = list(m.draw_shards(quota, 3))
    assert [s for s, _, _ in got] == list(range(len(got)))
    counts = np.array([c for _, c, _ in got])
    assert counts.min() >= 0 and counts.sum(axis=0).tolist() == quota and (counts.sum(axis=1)[:-1] == m.SHARD_SLOTS).all()
    assert (np.array([b for _, _, b in got]) == np.cumsum(counts, axis=0) - counts).all()
    part = list(m.draw_shards(quota, 3, 5, 9))  # a range of shards is the same whoever draws it
    assert [(s, c.tolist(), b.tolist()) for s, c, b in part] == [(s, c.tolist(), b.tolist()) for s, c, b in got[5:9]]
    assert list(m.draw_shards([], 3)) == list(m.draw_shards([0, 0], 3)) == []


def test_draws_of_very_many_shards():
    """Any shard comes from its path, in a mix of 10 ** 12 slots too."""
    quota = [10**12, 3, 5 * 10**11]
    (s, c, before), = m.draw_shards(quota, 3, 123_456_789, 123_456_790)
    assert s == 123_456_789 and c.sum() == m.SHARD_SLOTS and before.sum() == s * m.SHARD_SLOTS


def test_sources_of_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(m, "BUCKET_DOCS", 37)
    counts = spark.createDataFrame([(i, "ab"[i % 3 == 0], 1 + i % 50) for i in range(900)], "doc long, source string, n long")
    for s in "ab":
        at = sorted((r.block * 16 + r["at"], r.block * 16 + r["at"] + r.token_to - r.token_from) for r in m.pack(counts, "source", "doc", "n", 16).where(f"source = '{s}'").collect())
        total = sum(1 + i % 50 for i in range(900) if "ab"[i % 3 == 0] == s)
        assert at[0][0] == 0 and at[-1][1] == total and all(x[1] == y[0] for x, y in zip(at, at[1:]))


def docs():
    rows = [(i, "Big " if i % 2 else "big", 40 + i % 90, "x") for i in range(600)]
    rows += [(1000 + i, "small", 1000 if i == 0 else 30, "x") for i in range(10)]
    return rows + [(2000, None, 50, "x"), (2001, "small", 0, "x"), (2002, "other", 10, "x"), (2003, "big", None, "x")]


def test_mix(spark):
    counts = spark.createDataFrame(docs(), COUNTS)
    targets = spark.createDataFrame([("BIG", 0.5, 1), ("small", 0.3, 3), ("absent", 0.2, 9), (None, 0.1, 1)], TARGETS)
    mix = m.mix(counts, targets, block_tokens=16)
    rows = mix.rows.collect()
    used = defaultdict(Counter)
    for r in rows:
        for t in range(r.token_from, r.token_to):
            used[r.source][r.doc_id if "doc_id" in r else r.doc, t] += 1
    assert set(used) == {"big", "small"} and max(used["big"].values()) == 1 and max(used["small"].values()) <= 3
    big, small = sum(used["big"].values()), sum(used["small"].values())
    assert abs(small / (big + small) - 0.3 / 0.8) < 0.01
    assert small > 0.95 * 3 * 1270
    slots = mix.slots.collect()
    assert len({(s.shard, s.slot) for s in slots}) == len(slots)
    by_block = Counter((r.shard, r.slot) for r in rows)
    assert set(by_block) == {(s.shard, s.slot) for s in slots}
    size = defaultdict(int)
    for r in rows:
        size[r.shard, r.slot] += r.token_to - r.token_from
    assert sorted(size.values())[0] > 0 and Counter(size.values()).most_common(1)[0][0] == 16
    assert sorted(map(tuple, rows)) == sorted(map(tuple, m.mix(counts, targets, block_tokens=16).rows.collect()))
    share = {r.source: r for r in m.shares(mix.rows, counts, targets).collect()}
    assert set(share) == {"big", "small", "absent", "other", None}
    assert share["small"].mixed_tokens == small and share["small"].repeats == 3 and share["absent"].share == 0


def test_given_size_and_no_source(spark):
    counts = spark.createDataFrame(docs(), COUNTS)
    targets = spark.createDataFrame([("big", 0.5, None), ("small", 0.5, 1)], TARGETS)
    got = {r.source: r.mixed_tokens for r in m.shares(m.mix(counts, targets, block_tokens=16, total_tokens=1600).rows, counts, targets).collect()}
    assert abs(got["big"] - 800) <= 16 and abs(got["small"] - 800) <= 16
    empty = m.mix(counts, targets.where("source = 'none'"))
    assert empty.rows.count() == 0
    assert m.mix(counts.limit(0), targets).rows.count() == 0
