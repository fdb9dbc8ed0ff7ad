"""Applying a feed of inserts, updates and deletes stored with repeats and out of order, in SQL.

An entry's last writer wins per column, counting only changes after its latest delete or
replacement; what makes this more than a ``max_by`` is that a change counts only if it took effect.
An insert has none while the entry is open, a reduction none while it is closed, and the entry a
replacement opens depends on whether the replaced entry, under another key, was open.

A key with more rows than a task should hold is first squeezed in blocks of the sequence: changes that
the one before them leaves without effect (a delete or reduction after an end, an insert after an
insert) go, and reductions between any two other changes are summed. What is left of it is cut into its
segments in blocks too, so that a key's lives are spread over tasks.

Within a key, ends cut the changes into segments that all start closed, and running sums inside a
segment tell where it opened and where reductions used it up, so a key of any length is a streamed
sort, never a collected array. Across keys, replacements are first taken to have worked; those
whose original was not open are then struck out together with all they opened (by pointer doubling
over the replacement chains, so a chain of n costs log n joins), and only the keys they would have
opened are worked out again, until nothing changes. Each dependency points back in the sequence, so
the result is the only consistent one, the one that a message-by-message replay gives.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.operators.carry import carry_max
from tidebook.operators.hot import HOT_ROWS, hot_keys
from tidebook.operators.ordered import prefix_sums, previous
from tidebook.runtime import materialize

#: Kinds of a key's changes; ends sort before the births of the same sequence number.
DELETE, REPLACED, INSERT, REPLACEMENT, REDUCE = 0, 1, 2, 3, 4


@dataclass
class OpenEntries:
    """``entries``: period, part, id, ``since`` (sequence of the change that opened it), ``left``.
    ``changes``: the feed, a row per key and sequence, kinds as above; hot keys' reductions summed."""

    entries: DataFrame
    changes: DataFrame


def once(feed: DataFrame) -> DataFrame:
    """Each (period, seq) once: of repeats the row with the smallest ``row_id`` acts. Rows without
    a period or sequence cannot be ordered, rows without a part or id name no entry: left out."""
    return feed.sparkSession.sql(
        """
        SELECT period, seq, kind, part, id, new_id, qty FROM (
          SELECT period, seq, min_by(kind, row_id) AS kind, min_by(part, row_id) AS part, min_by(id, row_id) AS id,
                 min_by(new_id, row_id) AS new_id, min_by(qty, row_id) AS qty
          FROM {feed} WHERE period IS NOT NULL AND seq IS NOT NULL GROUP BY period, seq)
        WHERE part IS NOT NULL AND id IS NOT NULL AND kind IS NOT NULL
        """,
        feed=feed,
    )


def by_key(messages: DataFrame) -> DataFrame:
    """A replacement is an end of its original and, where it names one, a birth of its new id."""
    return messages.sparkSession.sql(
        """
        SELECT period, part, inline(CASE WHEN kind = 1 AND new_id IS NOT NULL
          THEN array(named_struct('id', id, 'kind', 1), named_struct('id', new_id, 'kind', 3))
          ELSE array(named_struct('id', id, 'kind', kind)) END), seq, qty
        FROM {messages}
        """,
        messages=messages,
    )


KEYS = ["period", "part", "id"]


#: Sequence numbers a block of a hot key.
SEQ_BLOCK = 1 << 16


def squeeze(changes: DataFrame, seq_block: int = SEQ_BLOCK) -> DataFrame:
    """Leave out what cannot have an effect and sum a key's reductions between two other changes into
    the last of them. Negative ones, which would make the order of sums matter, stay as they are."""
    # the place of a change in its key; ends come before births of the same sequence number
    placed = changes.withColumn("at", F.expr("seq * 8 + kind"))
    before = previous(placed, KEYS, "at", ["kind"], F.expr(f"at div {8 * seq_block}"))
    useless = F.expr("coalesce((prev.kind <= 1 AND kind IN (0, 4)) OR (prev.kind = 2 AND kind IN (2, 3)), false)")
    left = before.where(~useless).select(*changes.columns)
    sums = (F.col("kind") == REDUCE) & (F.coalesce(F.col("qty"), F.lit(0)) >= 0)
    marked = carry_max(left.withColumn("gap", F.when(~sums, F.col("seq"))), KEYS, "seq", ["gap"], block=F.expr(f"seq div {seq_block}"))
    summed = marked.where(sums).groupBy(*KEYS, "gap").agg(F.max("seq").alias("seq"), F.sum("qty").alias("qty"))
    return marked.where(~sums).select(*changes.columns).unionByName(summed.withColumn("kind", F.lit(REDUCE)).select(*changes.columns))


def segments(rows: DataFrame, seq_block: int | None) -> DataFrame:
    """``rows`` with the number of ends before each in its key (``seg``) and whether it is the key's last
    change and no end. With ``seq_block`` a key of any length is spread over its blocks."""
    if seq_block is None:
        return rows.sparkSession.sql(
            """
            SELECT *, 0 AS life, lead(seq) OVER k IS NULL AND kind > 1 AS is_last,
              count(CASE WHEN kind <= 1 THEN 1 END) OVER (PARTITION BY period, part, id ORDER BY seq, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seg
            FROM {rows} WINDOW k AS (PARTITION BY period, part, id ORDER BY seq, kind)
            """,
            rows=rows,
        )
    placed = rows.withColumn("at", F.expr("seq * 8 + kind"))
    cut = prefix_sums(placed, KEYS, ["at"], {"seg": F.expr("CASE WHEN kind <= 1 THEN 1 END")}, F.expr(f"at div {8 * seq_block}"), inclusive=False)
    ends = placed.groupBy(*KEYS).agg(F.max("at").alias("end"))
    return cut.join(ends, KEYS).selectExpr(*rows.columns, "0 AS life", "at = end AND kind > 1 AS is_last", "seg")


def settle_simple(changes: DataFrame) -> DataFrame:
    """One pass over all keys. Keys with one insert and no replacement birth are settled by running
    sums and give only their replaced rows and, if open, their last row; the others, of which
    ``chained`` is true, come out whole to be worked out together."""
    return changes.sparkSession.sql(
        """
        WITH a AS (
          SELECT *, sum(CASE WHEN kind = 2 THEN 1 WHEN kind = 3 THEN 2 ELSE 0 END) OVER whole AS births,
            min(CASE WHEN kind = 2 THEN seq END) OVER whole AS b, max(CASE WHEN kind = 2 THEN qty END) OVER whole AS size,
            lead(seq) OVER (PARTITION BY period, part, id ORDER BY seq, kind) IS NULL AS is_last
          FROM {changes}
          WINDOW whole AS (PARTITION BY period, part, id ORDER BY seq, kind ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
        r AS (
          SELECT *, sum(CASE WHEN kind <= 1 AND seq > b THEN 1 ELSE 0 END) OVER run AS ends,
            sum(CASE WHEN kind = 4 AND seq > b THEN qty END) OVER run AS used,
            max(CASE WHEN kind = 4 AND seq > b THEN 1 ELSE 0 END) OVER run AS reduced
          FROM a WINDOW run AS (PARTITION BY period, part, id ORDER BY seq, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
        SELECT period, part, id, seq, kind, qty, births > 1 AS chained, b AS since, size - coalesce(used, 0) AS left,
          is_last AND kind > 1 AS is_last,
          coalesce(seq >= b, false) AND ends = (CASE WHEN kind <= 1 THEN 1 ELSE 0 END) AND NOT (reduced = 1 AND coalesce(used >= size, false)) AS is_open
        FROM r
        WHERE births > 1 OR kind = 1 OR (is_last AND kind > 1 AND seq >= b AND ends = 0 AND NOT (reduced = 1 AND coalesce(used >= size, false)))
        """,
        changes=changes,
    )


_EVALUATE = """
    WITH w AS (
      SELECT period, part, id, seg, life, seq, kind, qty, is_last,
        count(CASE WHEN kind IN (2, 3) THEN 1 END) OVER run AS births,
        first(CASE WHEN kind IN (2, 3) THEN struct(qty, kind, seq) END, true) OVER run AS b
      FROM {rows}
      WINDOW run AS (PARTITION BY period, part, id, seg, life ORDER BY seq, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    u AS (
      SELECT *, sum(CASE WHEN kind = 4 AND births > 0 THEN qty END) OVER run AS used,
        max(CASE WHEN kind = 4 AND births > 0 THEN 1 ELSE 0 END) OVER run AS reduced
      FROM w WINDOW run AS (PARTITION BY period, part, id, seg, life ORDER BY seq, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    x AS (
      SELECT *, coalesce(max(reduced = 1 AND coalesce(used >= b.qty, false)) OVER run, false) AS gone,
        coalesce(max(reduced = 1 AND coalesce(used >= b.qty, false)) OVER before, false) AS gone_before
      FROM u WINDOW run AS (PARTITION BY period, part, id, seg, life ORDER BY seq, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        before AS (PARTITION BY period, part, id, seg, life ORDER BY seq, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT period, part, id, seg, life, seq, kind, qty, is_last, births > 0 AND NOT gone AS is_open,
      b.seq AS since, b.kind AS since_kind, b.qty - coalesce(used, 0) AS left,
      gone_before AND max(gone_before AND kind IN (2, 3)) OVER
        (PARTITION BY period, part, id, seg, life ORDER BY seq, kind ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS again
    FROM x
"""


def evaluate(rows: DataFrame, seq_block: int | None = None) -> DataFrame:
    """Whether an entry is open at each change of its key, all births in ``rows`` taken as offered;
    for an end, whether it was open just before. A birth after reductions used the entry up starts
    another life of the segment: the rest of such segments goes round again."""
    spark = rows.sparkSession
    todo = segments(rows, seq_block)
    done: DataFrame | None = None
    while True:
        got = materialize(spark.sql(_EVALUATE, rows=todo), "lives")
        part = got.where("NOT again").drop("again")
        done = part if done is None else done.unionByName(part)
        again = got.where("again")
        if again.isEmpty():
            return done
        todo = again.selectExpr("period", "part", "id", "seq", "kind", "qty", "life + 1 AS life", "is_last", "seg")


def struck_out(replacements: DataFrame) -> DataFrame:
    """(period, seq) of the replacements that failed or descend from one that did. ``replacements``
    has period, seq, ``ok`` and ``parent``, the seq of the replacement that opened the original."""
    spark = replacements.sparkSession
    bad = replacements.where("NOT ok").select("period", "seq")
    active = replacements.where("ok AND parent IS NOT NULL").select("period", "seq", "parent")
    hop = """
        SELECT a.period, a.seq, t.parent, t.bad FROM {active} a
        JOIN (SELECT period, seq, parent, bad FROM {steps}
              UNION ALL SELECT period, seq, CAST(NULL AS BIGINT), true FROM {bad}) t
        ON a.period = t.period AND a.parent = t.seq
    """
    while not active.isEmpty():
        once = spark.sql(hop, active=active, steps=active.selectExpr("*", "false AS bad"), bad=bad)
        # a chain becomes a quarter as long each time
        twice = spark.sql(hop, active=once.where("NOT bad"), steps=once, bad=bad)
        step = materialize(once.where("bad").select("period", "seq", "parent", "bad").unionByName(twice), "chain")
        bad = bad.unionByName(step.where("bad").select("period", "seq"))
        active = step.where("NOT bad").select("period", "seq", "parent")
    return bad


def settle(chained: DataFrame, evaluate: Callable[[DataFrame], DataFrame], alone: DataFrame | None = None) -> DataFrame:
    """What ``evaluate`` says of ``chained`` once failed replacements open nothing: all are taken to work
    first, and only keys that a failed one would have opened are worked out again. ``alone``: the
    replacements of other keys, settled already, if any."""
    spark = chained.sparkSession
    result = evaluate(chained)
    parents = result.where("kind = 1").selectExpr("period", "seq", "is_open AS ok", "CASE WHEN is_open AND since_kind = 3 THEN since END AS parent")
    replacements = parents if alone is None else materialize(alone.unionByName(parents), "replacements")
    struck = materialize(struck_out(replacements), "struck")
    changed = struck
    while True:
        touched = materialize(chained.where("kind = 3").join(changed, ["period", "seq"], "left_semi").select(*KEYS).distinct(), "touched")
        if touched.isEmpty():
            return result
        redo = chained.join(touched, KEYS, "left_semi")
        births = redo.where("kind = 3").join(struck, ["period", "seq"], "left_anti")
        fresh = evaluate(redo.where("kind <> 3").unionByName(births.select(*redo.columns)))
        result = result.join(touched, KEYS, "left_anti").unionByName(fresh)
        judged = spark.sql(
            """
            SELECT f.period, f.seq, f.is_open AS ok FROM {fresh} f LEFT JOIN {struck} s ON f.period = s.period AND f.seq = s.seq
            WHERE f.kind = 1 AND f.is_open = (s.seq IS NOT NULL)
            """,
            fresh=fresh,
            struck=struck,
        )
        judged = materialize(judged, "judged")
        if judged.isEmpty():
            return result
        changed = judged.select("period", "seq")
        struck = materialize(struck.join(changed, ["period", "seq"], "left_anti").unionByName(judged.where("NOT ok").select("period", "seq")), "struck")


def open_entries(feed: DataFrame, hot_rows: int = HOT_ROWS, seq_block: int = SEQ_BLOCK) -> OpenEntries:
    """The entries open after the last change of each period.

    ``feed``: ``period``, ``seq``, ``row_id``, ``kind`` (0 delete, 1 replace, 2 insert, 4 reduce),
    ``part`` and ``id`` (the entry, within the period), ``new_id`` (replace), ``qty`` (insert and
    replace: the size; reduce: what is taken off). A null size is unknown and never used up; a null
    reduction takes nothing off. Other columns are not read. No rows: no entries."""
    spark = feed.sparkSession
    changes = by_key(once(feed))
    hot = hot_keys(by_key(feed.where("period IS NOT NULL AND seq IS NOT NULL AND kind IS NOT NULL")), KEYS, hot_rows)  # repeats counted too, which saves a shuffle
    cold, block = changes, None
    if hot is not None:
        squeezed = materialize(squeeze(hot.of(changes), seq_block), "squeezed")
        cold, block = hot.others(changes), seq_block
    first = materialize(settle_simple(cold), "settled")
    chained = first.where("chained").select("period", "part", "id", "seq", "kind", "qty")
    if hot is not None:
        changes, chained = cold.unionByName(squeezed), chained.unionByName(squeezed.select(*chained.columns))
    alone = first.where("NOT chained AND kind = 1").selectExpr("period", "seq", "is_open AS ok", "CAST(NULL AS BIGINT) AS parent")
    result = settle(chained, lambda rows: evaluate(rows, block), alone)
    keys = KEYS
    entries = first.where("NOT chained AND is_last AND is_open").select(*keys, "since", "left").unionByName(result.where("is_last AND is_open").select(*keys, "since", "left"))
    return OpenEntries(entries, changes)


def last_values(entries: DataFrame, writes: DataFrame, fields: list[str]) -> DataFrame:
    """Column-wise last writer wins: for every open entry and field the value of the last change
    that set it, among changes from the one that opened the entry on. ``writes``: period, part, id,
    seq and the fields, null where a change does not set one."""
    picks = ", ".join(f"max_by(w.`{f}`, w.seq) FILTER (WHERE w.`{f}` IS NOT NULL AND w.seq >= e.since) AS `{f}`" for f in fields)
    return entries.sparkSession.sql(
        f"""
        SELECT e.period, e.part, e.id, e.since, e.left, {picks}
        FROM {{entries}} e LEFT JOIN {{writes}} w ON e.period = w.period AND e.part = w.part AND e.id = w.id
        GROUP BY e.period, e.part, e.id, e.since, e.left
        """,
        entries=entries,
        writes=writes,
    )
