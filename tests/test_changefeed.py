"""Open entries against a message-by-message replay, on random feeds made to collide."""

import random

from tidebook.operators import changefeed
from tidebook.operators.changefeed import last_values, open_entries, struck_out

SCHEMA = "period string, seq long, row_id long, kind int, part int, id long, new_id long, qty long, extra string"


def replay(rows):
    state, seen = {}, set()
    for p, q, _, kind, part, i, new, qty, _ in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2])):
        if (p, q) in seen:
            continue
        seen.add((p, q))
        if part is None or i is None:
            continue
        k = (p, part, i)
        if kind == 2:
            state.setdefault(k, qty)
        elif kind == 4 and k in state:
            if state[k] is not None:
                state[k] -= qty or 0
                if state[k] <= 0:
                    del state[k]
        elif kind == 0:
            state.pop(k, None)
        elif kind == 1 and k in state:
            del state[k]
            if new is not None:
                state.setdefault((p, part, new), qty)
    return state


def feed(seed, n, ids, null=0.0, chain=0):
    rnd = random.Random(seed)
    rows = []
    for q in range(n):
        kind = rnd.choice([2, 2, 1, 1, 1, 4, 4, 4, 0])
        maybe = lambda x: None if rnd.random() < null else x
        rows.append(("d%d" % rnd.randrange(2), q, 10 * q, kind, maybe(rnd.randrange(2)), maybe(rnd.randrange(ids)), maybe(rnd.randrange(ids)) if kind == 1 else None, maybe(rnd.randrange(0, 6)), "x"))
    for k in range(chain):
        rows.append(("c", k, 0, 2 if k == 0 else 1, 1, 10_000 + k - (k > 0), 10_000 + k if k else None, 5, "x"))
    rows += [(r[0], r[1], r[2] + 5, r[3], r[4], r[5], r[6], r[7], "again") for r in rows if rnd.random() < 0.2]
    rnd.shuffle(rows)
    return rows


def renamed(rows, name):
    return [(None if r[0] is None else f"{name}{r[0]}", *r[1:]) for r in rows]


def test_against_replay(spark):
    """Feeds of many shapes as periods of one, among them a chain whose head was lost."""
    shapes = [(1, 300, 8, 0.0, 0), (2, 400, 30, 0.05, 0), (3, 250, 4, 0.0, 40), (4, 500, 100, 0.02, 0), (5, 60, 1, 0.0, 0)]
    rows = [r for s in shapes for r in renamed(feed(*s), s[0])]
    rows += renamed([r for r in feed(7, 0, 1, 0.0, 60) if not (r[0] == "c" and r[1] == 0)], "lost")
    rows += [(None, 1, 1, 2, 1, 1, None, 5, "x"), ("p", None, 1, 2, 1, 1, None, 5, "x")]
    got = {(r.period, r.part, r.id): r.left for r in open_entries(spark.createDataFrame(rows, SCHEMA)).entries.collect()}
    assert got == replay(rows)
    assert not any(k[0].startswith("lost") for k in got)


def test_hot_keys_are_squeezed(spark):
    """A key hot by reductions, one by inserts, one by deletes, one by lives that follow each other."""
    rnd = random.Random(11)
    rows = feed(21, 200, 5, 0.03)
    rows += [("h", q, q, rnd.choice([4] * 30 + [2, 1, 0]), 1, rnd.choice([1, 1, 1, 2]), 2, rnd.choice([0, 1, 1, 30, -2, None]) if q % 40 else 90, "x") for q in range(600)]
    for q in range(600, 1200):
        i = rnd.choice([3, 4, 5])
        kind = {3: rnd.choice([2] * 40 + [0, 4]), 4: rnd.choice([0] * 40 + [2, 4]), 5: (2, 0)[q % 2]}[i]
        rows.append(("h", q, q, kind, 1, i, None, rnd.randrange(1, 4), "x"))
    df = spark.createDataFrame(rows, SCHEMA)
    got = open_entries(df, hot_rows=0, seq_block=16)
    assert {(r.period, r.part, r.id): r.left for r in got.entries.collect()} == replay(rows)
    assert {(r.period, r.part, r.id): r.left for r in open_entries(df, hot_rows=100, seq_block=64).entries.collect()} == replay(rows)
    for key, few in (("kind = 4 AND id IN (1, 2)", 0.5), ("id = 3", 0.3), ("id = 4", 0.3)):
        key = f"period = 'h' AND {key}"
        assert got.changes.where(key).count() < changefeed.by_key(changefeed.once(df)).where(key).count() * few


def test_empty(spark):
    assert open_entries(spark.createDataFrame([], SCHEMA)).entries.count() == 0


def test_struck_out_follows_chains(spark):
    df = spark.createDataFrame([("d", 1, False, None), ("d", 2, True, 1), ("d", 3, True, 2), ("d", 4, True, 3), ("d", 5, True, None), ("d", 6, True, 5)], "period string, seq long, ok boolean, parent long")
    assert sorted(r.seq for r in struck_out(df).collect()) == [1, 2, 3, 4]


def test_last_values_counts_only_changes_since(spark):
    entries = spark.createDataFrame([("d", 1, 7, 5, 3)], "period string, part int, id long, since long, left long")
    writes = spark.createDataFrame([("d", 1, 7, 2, 100, "old"), ("d", 1, 7, 5, 200, None), ("d", 1, 7, 6, None, "new")], "period string, part int, id long, seq long, price long, note string")
    r = last_values(entries, writes, ["price", "note"]).first()
    assert (r.price, r.note) == (200, "new")
