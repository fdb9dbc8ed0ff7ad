"""Percentiles of very large numeric columns from mergeable dyadic-tree summaries (q-digests).

Values are quantized to the integers 0 .. 2**BITS - 1. A summary is a set of counted nodes of the
binary tree over them: (level, node) covers the 2**level values from node * 2**level. Two children
are folded into their parent while the three hold at most n / k rows together, so an inner node
never holds more than n / k and a summary has at most about 3 k nodes. Summaries merge by adding
counts node by node, which keeps that bound with the added n. A rank read from a summary is off
by at most the counts of the inner nodes over the answer: BITS * floor(n / k), whatever the data, the
order of the rows or the number of merges.

Each task folds what it reads, so it sends at most about 3 k nodes a group; these are added and folded
again in levels, FAN_IN tasks' summaries of a group at a time, so that no task meets those of all.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 32
#: Nodes a task holds before it folds them.
HELD = 1_000_000
#: So many partial summaries of a group meet in one task at most.
FAN_IN = 64


def size_for(eps: float) -> int:
    """The k with which ranks are off by at most eps * n."""
    return math.ceil(BITS / eps)


def quantize(c: Column, lo: float = 0, step: float = 1) -> Column:
    """The cell of ``c`` in the universe. Values below ``lo`` go to the first cell, values beyond
    the last and NaN to the last; null stays null."""
    cell = c if lo == 0 and step == 1 else (c - F.lit(lo)) / F.lit(step)
    # least and greatest skip nulls and take NaN for the greatest number; the cast cuts fractions
    return F.when(c.isNotNull(), F.least(F.greatest(cell, F.lit(0)), F.lit((1 << BITS) - 1)).cast("long"))


def fold(group: np.ndarray, level: np.ndarray, node: np.ndarray, count: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """Fold the trees of all groups at once. ``group`` holds codes 0 .. ; a (group, level, node)
    occurs once. Returns the four arrays of the folded trees."""
    if not len(group):
        return group, level, node, count
    limit = np.bincount(group, weights=count).astype(np.int64) // k
    done = []
    slim = limit[group] == 0  # too few rows to fold anything
    done.append((group[slim], level[slim], node[slim], count[slim]))
    group, level, node, count = (x[~slim] for x in (group, level, node, count))
    waiting_key, waiting_count = np.empty(0, np.int64), np.empty(0, np.int64)
    for at in range(BITS + 1):
        here = level == at
        key = np.concatenate([waiting_key, (group[here] << BITS) | node[here]])
        cnt = np.concatenate([waiting_count, count[here]])
        key, inverse = np.unique(key, return_inverse=True)
        cnt = np.bincount(inverse, weights=cnt, minlength=len(key)).astype(np.int64) if len(key) else np.empty(0, np.int64)
        if at == BITS or not len(key):
            done.append((key >> BITS, np.full(len(key), at, level.dtype), key & ((1 << BITS) - 1), cnt))
            waiting_key = waiting_count = np.empty(0, np.int64)
            continue
        g, parent = key >> BITS, (key & ((1 << BITS) - 1)) >> 1
        up = (g << BITS) | parent
        first = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
        total = np.add.reduceat(cnt, first)
        above = level == at + 1
        own_key = (group[above] << BITS) | node[above]
        order = np.argsort(own_key)
        own_key, own = own_key[order], count[above][order]
        pos = np.searchsorted(own_key, up[first])
        found = pos < len(own_key)
        found[found] = own_key[pos[found]] == up[first][found]
        whole = total.copy()
        whole[found] += own[pos[found]]
        fits = whole <= limit[g[first]]
        each = np.repeat(fits, np.diff(np.r_[first, len(key)]))
        done.append((g[~each], np.full((~each).sum(), at, level.dtype), (key & ((1 << BITS) - 1))[~each], cnt[~each]))
        waiting_key, waiting_count = up[first][fits], total[fits]
    return tuple(np.concatenate(x) for x in zip(*done))


def _fold_table(t: pa.Table, keys: Sequence[str], k: int) -> pa.Table:
    """Add equal nodes and fold; ``t`` has keys, __level, __node, __count."""
    t = t.group_by([*keys, "__level", "__node"], use_threads=False).aggregate([("__count", "sum")]).rename_columns([*keys, "__level", "__node", "__count"])
    if not t.num_rows:
        return t
    groups = t.select(list(keys)).group_by(list(keys), use_threads=False).aggregate([])
    if groups.num_rows == 1:
        code = np.zeros(t.num_rows, np.int64)
    else:
        # codes of the groups, by one dictionary a key column
        code = np.zeros(t.num_rows, np.int64)
        for name in keys:
            d = t[name].combine_chunks().dictionary_encode(null_encoding="encode")
            code = np.unique(code * (len(d.dictionary) + 1) + d.indices.to_numpy(zero_copy_only=False), return_inverse=True)[1].astype(np.int64)
    first = np.zeros(code.max() + 1, np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    g, lv, nd, ct = fold(code, t["__level"].to_numpy(), t["__node"].to_numpy(), t["__count"].to_numpy(), k)
    at = pa.array(first[g])
    return pa.table([*[t[n].take(at) for n in keys], pa.array(lv, pa.int32()), pa.array(nd, pa.int64()), pa.array(ct, pa.int64())], names=[*keys, "__level", "__node", "__count"])


def _partial(keys: Sequence[str], names: Sequence[str], k: int):
    """Folds a task's rows, all metrics together; their column follows ``keys``."""
    given, keys = list(keys), [*keys, "metric"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for b in batches:
            t = pa.Table.from_batches([b])
            for i, name in enumerate(names):
                one = t.select([*given, f"__c{i}"]).rename_columns([*given, "__node"])
                one = one.filter(pc.is_valid(one["__node"])).group_by([*given, "__node"], use_threads=False).aggregate([([], "count_all")]).rename_columns([*given, "__node", "__count"])
                n = one.num_rows
                held.append(pa.table([*[one[c] for c in given], pa.array([name] * n, pa.string()), pa.array(np.zeros(n, np.int32)), one["__node"], one["__count"]], names=[*keys, "__level", "__node", "__count"]))
            if sum(x.num_rows for x in held) > HELD:
                held = [_fold_table(pa.concat_tables(held), keys, k)]
                if held[0].num_rows > HELD // 2:  # many groups: hand over, the merge adds them
                    yield from held.pop().to_batches(max_chunksize=50_000)
        if held:
            yield from _fold_table(pa.concat_tables(held), keys, k).to_batches(max_chunksize=50_000)

    return run


def _refold(keys: Sequence[str], k: int):
    """Folds whole groups; the input is sorted by ``keys`` inside a partition. Pieces of the group that a
    batch breaks off in wait as they are and are folded when they are many, so a group of any number of
    summaries is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        last: tuple | None = None

        def folded() -> pa.Table:
            return _fold_table(pa.concat_tables(held).combine_chunks(), keys, k)

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            differs = np.zeros(t.num_rows, bool)
            for n in keys:
                v = t[n].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                differs |= v != v[-1]
            cut = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
            if cut or last is not None and last != tuple(t[n][0].as_py() for n in keys):
                held.append(t.slice(0, cut))
                yield from folded().to_batches(max_chunksize=50_000)
                held = []
            held.append(t.slice(cut))
            last = tuple(t[n][-1].as_py() for n in keys)
            if len(held) > 1 and sum(x.num_rows for x in held) > HELD:
                held = [folded()]
        if held:
            yield from folded().to_batches(max_chunksize=50_000)

    return run


def _schema(df: DataFrame, keys: Sequence[str], *more: str) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"`{n}` {types[n]}" for n in keys), *more, "__level int", "__node long", "__count long"])


def summarize(df: DataFrame, keys: Sequence[str], cells: Mapping[str, Column], eps: float) -> DataFrame:
    """Summaries of each of ``cells`` (name to column, see ``quantize``) per ``keys``: keys, ``metric``
    (the name), ``__level``, ``__node``, ``__count``. Rows with a null cell are left out of its metric;
    null keys are groups like any other; repeated rows count; an empty table gives no summary."""
    k = size_for(eps)
    leaves = df.select(*keys, *[c.alias(f"__c{i}") for i, c in enumerate(cells.values())])
    partial = leaves.mapInArrow(_partial(list(keys), list(cells), k), _schema(leaves, keys, "metric string"))
    whole = [*keys, "metric"]
    tasks = leaves.rdd.getNumPartitions()  # of a scan, that is, from its plan
    if tasks > FAN_IN:
        partial = partial.withColumn("__part", F.spark_partition_id())
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        partial = merge(partial.withColumn("__part", F.expr(f"__part div {FAN_IN}").cast("int")), [*whole, "__part"], eps)
    return merge(partial, whole, eps)


def merge(summaries: DataFrame, keys: Sequence[str], eps: float) -> DataFrame:
    """Add the summaries of each group of ``keys`` node by node and fold the sums. Summaries made
    with the same eps of separate partitions, files or days merge; other columns are dropped. For more
    than FAN_IN summaries a group, merge by a part of them first."""
    nodes = summaries.select(*keys, "__level", "__node", "__count")
    return nodes.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_refold(list(keys), size_for(eps)), _schema(nodes, keys))


def percentiles(summaries: DataFrame, keys: Sequence[str], probs: Sequence[float], eps: float, lo: float = 0, step: float = 1) -> DataFrame:
    """keys, ``p``, ``percentile`` (upper end of its cell's values), ``n``, ``max_rank_error``: the
    rank of ``percentile`` differs from max(1, ceil(p * n)) by at most that many rows. The window
    runs over a summary's nodes, of which a group has a bounded number."""
    k = size_for(eps)
    high = F.expr("shiftleft(__node + 1, __level) - 1")
    by = Window.partitionBy(*keys)
    post = by.orderBy("__high", "__level").rowsBetween(Window.unboundedPreceding, 0)
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("n"))).cast("long").alias("r")) for p in probs])
    cum = summaries.withColumn("__high", high).withColumn("n", F.sum("__count").over(by)).withColumn("__cum", F.sum("__count").over(post))
    return (
        cum.select(*keys, "n", "__high", "__cum", "__count", F.explode(ranks).alias("t"))
        .where((F.col("t.r") <= F.col("__cum")) & (F.col("t.r") > F.col("__cum") - F.col("__count")))
        .select(*keys, F.col("t.p").alias("p"), (F.col("__high") * F.lit(step) + F.lit(lo)).alias("percentile"), "n", (F.lit(BITS) * F.floor(F.col("n") / F.lit(k))).cast("long").alias("max_rank_error"))
    )
