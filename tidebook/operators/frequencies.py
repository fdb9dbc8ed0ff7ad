"""Per-key results over keys of which a few hold most rows, by value-frequency compression.

Rows are first grouped by (key, value), with map-side partial counts, so what is shuffled per key
is one weighted row per distinct value and map task, however many rows the key holds. Distinct
counts, modes and percentiles then come exactly from the weighted values; the percentile step
splits a key further by value range, so no task ever holds a whole hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHT = "__weight"
#: Buckets per power of two in the percentile step; a key has at most 2 * 2100 * SUB_BUCKETS of them.
SUB_BUCKETS = 512


def value_frequencies(df: DataFrame, keys: Sequence[str], value: str | Column, name: str = "value") -> DataFrame:
    """One row per distinct (keys, value) with its number of rows in ``__weight``.

    Null keys and null values are groups like any other (``key_profile`` counts null values as rows
    but not as values). Repeated rows count. An empty table gives no rows. Only ``keys`` and
    ``value`` are read, so extra columns, whatever their names, play no part."""
    v = F.col(value) if isinstance(value, str) else value
    return df.select(*[F.col(k) for k in keys], v.alias(name)).groupBy(*keys, name).agg(F.count(F.lit(1)).alias(WEIGHT))


def key_profile(freq: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Per key: ``n_rows``, ``n_values`` (rows with a value), ``n_distinct``, ``mode`` (the most
    frequent value, on ties the smallest; null without values) and ``mode_rows``."""
    known = F.col(value).isNotNull()
    rank = F.when(known, F.struct((-F.col(WEIGHT)).alias("w"), F.col(value).alias("v")))
    return (
        freq.groupBy(*keys)
        .agg(
            F.sum(WEIGHT).alias("n_rows"),
            F.coalesce(F.sum(F.when(known, F.col(WEIGHT))), F.lit(0)).cast("long").alias("n_values"),
            F.count(value).alias("n_distinct"),
            F.min(rank).alias("__m"),
        )
        .select(*keys, "n_rows", "n_values", "n_distinct", F.col("__m.v").alias("mode"), (-F.col("__m.w")).alias("mode_rows"))
    )


def value_bucket(c: Column) -> Column:
    """A monotone map of numbers to at most 2 * 2100 * SUB_BUCKETS ints: relative ranges of width
    2 ** (1 / SUB_BUCKETS), however small the numbers, mirrored for negatives. Zero has its own, as have
    infinities; NaN is the greatest."""
    d = c.cast("double")
    # doubles go from 2 ** -1074 to 2 ** 1024
    size = F.least(F.floor((F.log2(F.abs(d)) + F.lit(1075.0)) * F.lit(float(SUB_BUCKETS))), F.lit(2100 * SUB_BUCKETS)) + 1
    bucket = F.when(d == 0, F.lit(0)).when(F.isnan(d), F.lit(2100 * SUB_BUCKETS + 2)).when(F.abs(d) == float("inf"), F.signum(d) * (2100 * SUB_BUCKETS + 1)).otherwise(F.signum(d) * size)
    return bucket.cast("int")


def weighted_percentiles(freq: DataFrame, keys: Sequence[str], probs: Sequence[float], value: str = "value") -> DataFrame:
    """Exact percentiles: for each key and p the smallest value whose cumulative weight reaches
    ``max(1, ceil(p * n))``, n the rows with a value. Columns: keys, ``p``, ``percentile``.

    Two levels, neither holding a whole key: weights per (key, value bucket), of which a key has a
    bounded number, give the bucket each rank falls in; only those buckets' values are then ordered.
    Keys without values give no row."""
    known = freq.where(F.col(value).isNotNull()).withColumn("__b", value_bucket(F.col(value)))
    by_key = Window.partitionBy(*keys)
    buckets = (
        known.groupBy(*keys, "__b")
        .agg(F.sum(WEIGHT).alias("__bw"))
        .withColumn("__n", F.sum("__bw").over(by_key))
        .withColumn("__cum", F.sum("__bw").over(by_key.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)))
    )
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.greatest(F.lit(1), F.ceil(F.lit(float(p)) * F.col("__n"))).cast("long").alias("r")) for p in probs])
    hit = (
        buckets.select(*keys, "__b", (F.col("__cum") - F.col("__bw")).alias("__before"), "__cum", F.explode(ranks).alias("__t"))
        .where((F.col("__t.r") > F.col("__before")) & (F.col("__t.r") <= F.col("__cum")))
        .select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__hb"), F.col("__t.p").alias("p"), (F.col("__t.r") - F.col("__before")).alias("__need"))
    )
    on = [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [F.col("__b") == F.col("__hb")]
    inside = known.join(hit.hint("shuffle_merge"), on)
    run = Window.partitionBy(*keys, "__b", "p").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return (
        inside.withColumn("__c", F.sum(WEIGHT).over(run))
        .where(F.col("__c") >= F.col("__need"))
        .groupBy(*keys, "p")
        .agg(F.min(value).alias("percentile"))
    )


def heavy_keys(freq: DataFrame, period: Sequence[str], key: str, min_share: float) -> DataFrame:
    """Keys holding at least ``min_share`` of their period's rows, from value frequencies over
    (period, key, value). Rows whose key is null are left out of both sides. The share is
    compared in parts per million of integers, so it is exact."""
    per_key = freq.where(F.col(key).isNotNull()).groupBy(*period, key).agg(F.sum(WEIGHT).alias("n_rows"))
    total = per_key.groupBy(*[F.col(p).alias(f"__{p}") for p in period]).agg(F.sum("n_rows").alias("period_rows"))
    on = [F.col(p).eqNullSafe(F.col(f"__{p}")) for p in period]
    ppm = round(min_share * 1_000_000)
    return (
        per_key.join(total, on)
        .where(F.col("n_rows") * F.lit(1_000_000) >= F.col("period_rows") * F.lit(ppm))
        .select(*period, key, "n_rows", "period_rows")
    )
