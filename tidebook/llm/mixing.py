"""Mixing sources to target shares of tokens.

Per source, documents are laid end to end in a fixed pseudorandom order and cut into blocks of a
fixed number of tokens (the last one may be shorter). The mix is a sequence of slots in shards; each
shard draws from a multinomial how many of its slots each source gets, without replacement from
the sources' quotas, so the totals are met exactly. A source's j-th slot overall takes block
``perm(j mod n)`` of repeat ``j div n``, perm a pseudorandom permutation of its n blocks computed by
a Feistel network, so no block comes again before all others of its source have come and none more
often than allowed. Slots then join the blocks on source and index. Nothing but one row per source
passes the driver: the shards' draws are leaves of a tree that every task walks for its own range.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_TOKENS = 256
SHARD_SLOTS = 4096
#: Shards a task draws, where there are more than tasks can run at once.
TASK_SHARDS = 256
#: Documents of a source in a bucket of the running sums, on average.
BUCKET_DOCS = 65_536
MAX_TARGETS = 10_000


def normal_source(c: Column | str) -> Column:
    """Sources compare without case and outer blanks; null stays null."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def permute(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0 .. n-1 at the places ``j``: a Feistel network over the next
    even power of two, walked until it lands inside."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    out = j.astype(np.uint64)
    todo = np.arange(len(out))
    rounds = np.random.SeedSequence([key & 0xFFFFFFFF, key >> 32]).generate_state(6, np.uint64)
    while len(todo):
        x = out[todo]
        left, right = x >> np.uint64(half), x & mask
        for r in rounds:
            f = (right ^ r) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def pack(counts: DataFrame, source: str, doc: str, tokens: str, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """The blocks, one row per document in each: source, ``block``, ``doc``, ``token_from``,
    ``token_to`` (places in the document) and ``at`` (place in the block). Rows with a null source or
    without tokens are in no block. ``doc`` must be unique. A source of any size is summed by hash
    buckets of about BUCKET_DOCS of its documents, then within a bucket."""
    rows = counts.where(F.col(source).isNotNull() & (F.col(tokens) > 0)).select(source, doc, tokens)
    sizes = rows.groupBy(source).agg(F.count(F.lit(1)).alias("n")).limit(MAX_TARGETS + 1).collect()
    if len(sizes) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} sources")
    buckets = {r[source]: -(-r["n"] // BUCKET_DOCS) for r in sizes if r["n"] > BUCKET_DOCS}
    # sources of one bucket need no entry
    many = F.coalesce(F.create_map(*[F.lit(x) for kv in buckets.items() for x in kv])[F.col(source)], F.lit(1)) if buckets else F.lit(1)
    rows = rows.withColumn("__bucket", F.pmod(F.xxhash64(doc), many.cast("long")))
    sums = rows.groupBy(F.col(source).alias("__s"), F.col("__bucket").alias("__b")).agg(F.sum(tokens).alias("__sum"))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__s", "__b", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__offset"))
    inner = Window.partitionBy(source, "__bucket").orderBy(doc).rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.withColumn("__end", F.sum(tokens).over(inner)).join(offsets, (F.col(source) == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    start = F.col("__offset") + F.col("__end") - F.col(tokens)
    spans = placed.select(source, F.col(doc).alias("doc"), F.col(tokens).alias("__n"), start.alias("__start"))
    last = F.col("__start") + F.col("__n") - 1
    spans = spans.withColumn("block", F.explode(F.sequence(F.expr(f"__start div {block_tokens}"), F.floor(last / F.lit(block_tokens)))))
    lo = F.greatest(F.col("block") * block_tokens, F.col("__start"))
    hi = F.least((F.col("block") + 1) * block_tokens, F.col("__start") + F.col("__n"))
    return spans.select(source, "block", "doc", (lo - F.col("__start")).alias("token_from"), (hi - F.col("__start")).alias("token_to"), (lo - F.col("block") * block_tokens).cast("int").alias("at"))


@dataclass
class Plan:
    """Per source with a target: ``tokens`` there are, blocks ``n``, ``quota`` of slots."""

    sources: list[str]
    tokens: list[int]
    n: list[int]
    quota: list[int]


def plan_quotas(targets: Sequence[tuple[str, float, int, int]], block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None) -> Plan:
    """``targets``: (source, share, max_repeats, tokens there are). Shares of sources without any
    tokens go to the others in proportion. Without ``total_tokens`` the mix is as large as all
    shares can be met in; with it, a source that cannot give its part gives all it may."""
    live = sorted((s, w, r, t) for s, w, r, t in targets if w > 0 and t > 0 and r > 0)
    weight = sum(w for _, w, _, _ in live)
    if not live:
        return Plan([], [], [], [])
    total = total_tokens if total_tokens is not None else min(t * r / (w / weight) for _, w, r, t in live)
    n = [-(-t // block_tokens) for *_, t in live]
    quota = [min(k * r, max(1, round(w / weight * total / (t / k)))) for (_, w, r, t), k in zip(live, n)]
    return Plan([s for s, *_ in live], [t for *_, t in live], n, quota)


def draw_shards(quota: Sequence[int], seed: int, lo: int = 0, hi: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(shard, slots of each source in it, those of each in earlier shards) for shards ``lo`` to ``hi``,
    all by default. Shards are the leaves of a binary tree: a node's counts are split between its
    halves by draws with the chances its quotas give, corrected to the halves' sizes, so totals are
    exact and any range of shards comes from its path alone, whichever task asks."""
    total = int(sum(quota))
    n = -(-total // SHARD_SLOTS)
    hi = n if hi is None else min(hi, n)

    def walk(a: int, b: int, have: np.ndarray, before: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        if b <= lo or a >= hi:
            return
        if b - a == 1:
            yield a, have, before
            return
        mid = (a + b) // 2
        want = (mid - a) * SHARD_SLOTS
        left = np.random.default_rng([seed, a, b]).binomial(have, want / have.sum())
        gap = want - int(left.sum())
        while gap:  # spread what is missing or too much by what each source can still give or take
            room = have - left if gap > 0 else left
            part = np.minimum(room, -(-abs(gap) * room // room.sum()))
            over = np.cumsum(part) - abs(gap)
            part = np.maximum(part - np.maximum(over, 0), 0)
            left = left + (part if gap > 0 else -part)
            gap = want - int(left.sum())
        yield from walk(a, mid, left, before)
        yield from walk(mid, b, have - left, before + left)

    if n:
        yield from walk(0, n, np.array(quota, np.int64), np.zeros(len(quota), np.int64))


def _slots(plan: Plan, seed: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            ids = np.sort(f["id"].to_numpy())  # a task's shards follow each other
            for shard, counts, before in draw_shards(plan.quota, seed, int(ids[0]), int(ids[-1]) + 1) if len(ids) else ():
                code = np.repeat(np.arange(len(counts)), counts)
                j = np.concatenate([b + np.arange(c) for b, c in zip(before, counts)])
                n = np.asarray(plan.n, np.int64)[code]
                repeat, block = j // n, np.empty(len(j), np.int64)
                for c in range(len(counts)):
                    for e in np.unique(repeat[code == c]):
                        pick = (code == c) & (repeat == e)
                        block[pick] = permute(j[pick] % plan.n[c], plan.n[c], (seed * 1_000_003 + c * 8191 + int(e)) & (2**63 - 1))
                slot = np.random.default_rng([seed, shard]).permutation(len(j))
                yield pd.DataFrame({"shard": shard, "slot": slot, "source": np.asarray(plan.sources, object)[code], "block": block, "repeat": repeat.astype(np.int32)})

    return run


@dataclass
class Mix:
    """``slots``: shard, slot, source, block, repeat. ``rows``: these with the documents of each
    block (see ``pack``)."""

    slots: DataFrame
    rows: DataFrame


def mix(counts: DataFrame, targets: DataFrame, *, doc: str = "doc_id", source: str = "source", tokens: str = "n_tokens", block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None, seed: int = 17) -> Mix:
    """Mix ``counts`` (documents with their tokens; read several times, so give a written table) to
    ``targets``: ``source``, ``target_share``, ``max_repeats`` (null: 1; null shares: 0), at most
    MAX_TARGETS rows. Sources compare as ``normal_source``; of a target named twice the shares add up
    and the smaller cap holds. Documents without a targeted source are not used. No usable source: no
    rows. Equal inputs and seeds give equal mixes."""
    spark = counts.sparkSession
    named = counts.select(F.col(doc).alias("doc_id"), normal_source(source).alias("source"), F.col(tokens).alias("n_tokens"))
    wanted = targets.groupBy(normal_source("source").alias("source")).agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("w"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("r")).where(F.col("source").isNotNull())
    few = wanted.count() <= MAX_TARGETS
    have = named.join(F.broadcast(wanted.select("source")) if few else wanted.select("source"), "source").groupBy("source").agg(F.sum("n_tokens").alias("t"))
    rows = wanted.join(have, "source").limit(MAX_TARGETS + 1).collect()
    if len(rows) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    plan = plan_quotas([(r["source"], r["w"], r["r"], r["t"]) for r in rows], block_tokens, total_tokens)
    n_shards = -(-sum(plan.quota) // SHARD_SLOTS)
    tasks = max(1, min(n_shards, max(spark.sparkContext.defaultParallelism, n_shards // TASK_SHARDS)))
    slots = spark.range(0, n_shards, 1, tasks).mapInPandas(_slots(plan, seed), "shard long, slot int, source string, block long, repeat int")
    blocks = pack(named.join(F.broadcast(wanted.select("source")) if few else wanted.select("source"), "source"), "source", "doc_id", "n_tokens", block_tokens)
    # the slots' size is estimated from the few shard rows they are made of; unhinted, Spark would
    # broadcast them however many there are
    return Mix(slots, slots.hint("merge").join(blocks.hint("merge"), ["source", "block"]))


def shares(rows: DataFrame, counts: DataFrame, targets: DataFrame, *, source: str = "source", tokens: str = "n_tokens") -> DataFrame:
    """One row per source on either side: ``source``, ``target_share``, ``available_tokens``,
    ``mixed_tokens``, ``share`` reached and ``repeats``, the most times a block was used."""
    used = rows.groupBy("source").agg(F.sum(F.col("token_to") - F.col("token_from")).alias("mixed_tokens"), (F.max("repeat") + 1).alias("repeats"))
    have = counts.groupBy(normal_source(source).alias("source")).agg(F.sum(tokens).alias("available_tokens"))
    wanted = targets.groupBy(normal_source("source").alias("source")).agg(F.sum("target_share").alias("target_share"))
    # at most MAX_TARGETS rows
    used = used.withColumn("__total", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1))))
    out = have.withColumn("__k", F.coalesce("source", F.lit("\x00"))).join(wanted.withColumn("__k", F.coalesce("source", F.lit("\x00"))).drop("source").withColumnRenamed("target_share", "ts"), "__k", "full_outer")
    out = out.select(F.when(F.col("__k") != "\x00", F.col("__k")).alias("source"), F.coalesce("ts", F.lit(0.0)).alias("target_share"), F.coalesce("available_tokens", F.lit(0)).cast("long").alias("available_tokens"))
    out = out.join(used, "source", "left")
    return out.select("source", "target_share", "available_tokens", F.coalesce("mixed_tokens", F.lit(0)).cast("long").alias("mixed_tokens"), F.coalesce(F.col("mixed_tokens") / F.col("__total"), F.lit(0.0)).alias("share"), F.coalesce("repeats", F.lit(0)).cast("int").alias("repeats"))
