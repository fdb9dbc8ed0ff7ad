"""Queries of this subpackage (p2, p3, p8, p9, p10) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.llm import mixing, qdigest, stuffing, tokens
from tidebook.llm.nearest import nearest
from tidebook.runtime import load, materialize

EPS = 0.001
PROBS = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99)
#: An error coarse enough to fold the groups of small tables, and percentiles of which it says something.
COARSE, MIDDLE = 0.1, (0.25, 0.5, 0.75)
#: Blocks a repeat by which a source may miss its share: its last block is a short one.
NEAR = 2
TOLERANCE_NS = 50_000_000


# 2 -------------------------------------------------------------------------------------------

def _metrics(spark: SparkSession, d: str) -> DataFrame:
    both = F.array(F.struct(F.lit("price").alias("metric"), F.col("price").alias("value")), F.struct(F.lit("shares").alias("metric"), F.col("shares").alias("value")))
    return load(spark, d, "add_order").select("session_date", "stock_locate", F.explode(both).alias("m")).select("session_date", "stock_locate", "m.metric", "m.value")


def _summaries(spark: SparkSession, d: str, eps: float) -> DataFrame:
    cells = {m: qdigest.quantize(F.col(m)) for m in ("price", "shares")}
    days = qdigest.summarize(load(spark, d, "add_order"), ["session_date", "stock_locate"], cells, eps)
    return qdigest.merge(days, ["stock_locate", "metric"], eps)


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return qdigest.percentiles(_summaries(spark, d, EPS), ["stock_locate", "metric"], PROBS, EPS).withColumn("percentile", F.col("percentile").cast("long"))


def _within(spark: SparkSession, d: str, got: DataFrame, eps: float) -> DataFrame:
    """Per group whether every percentile's exact rank, counted over all rows, is off by at most
    eps * n rows, and by no more than the bound the operator gives."""
    values = _metrics(spark, d).where("value IS NOT NULL").groupBy("stock_locate", "metric", qdigest.quantize(F.col("value")).alias("value")).agg(F.count(F.lit(1)).alias("w"))
    # per group a handful of percentiles against its distinct values
    at = F.struct("p", "percentile", "n", "max_rank_error")
    asked = got.groupBy("stock_locate", "metric").agg(F.collect_list(at).alias("a"))
    ranks = (
        values.join(asked, ["stock_locate", "metric"]).select("stock_locate", "metric", "value", "w", F.explode("a").alias("a"))
        .groupBy("stock_locate", "metric", "a")
        .agg(F.sum(F.when(F.col("value") < F.col("a.percentile"), F.col("w")).otherwise(0)).alias("below"), F.sum(F.when(F.col("value") <= F.col("a.percentile"), F.col("w")).otherwise(0)).alias("upto"))
    )
    r = F.greatest(F.lit(1), F.ceil(F.col("a.p") * F.col("a.n")))
    off = F.greatest(F.col("below") + 1 - r, r - F.col("upto"), F.lit(0))
    good = (off <= F.col("a.max_rank_error")) & (off <= F.lit(eps) * F.col("a.n"))
    return ranks.groupBy("stock_locate", "metric").agg(F.max("a.n").alias("n"), F.count(F.lit(1)).alias("n_percentiles"), F.min(good).alias("within_bound"))


def p2_within_bound(spark: SparkSession, d: str) -> DataFrame:
    return _within(spark, d, materialize(p2_percentiles(spark, d), "percentiles"), EPS)


def p2_coarse_within_bound(spark: SparkSession, d: str) -> DataFrame:
    """The same for an error so coarse that the trees of small groups are folded too: ``folded`` where a
    node of the tree may hold more than one row, ``small`` where the summary is as small as promised."""
    nodes = materialize(_summaries(spark, d, COARSE), "nodes")
    got = qdigest.percentiles(nodes, ["stock_locate", "metric"], MIDDLE, COARSE).withColumn("percentile", F.col("percentile").cast("long"))
    k = qdigest.size_for(COARSE)
    sizes = nodes.groupBy("stock_locate", "metric").agg((F.count(F.lit(1)) <= 3 * k).alias("small"), (F.sum("__count") >= 2 * k).alias("folded"))
    return _within(spark, d, got, COARSE).join(sizes, ["stock_locate", "metric"])


# 3 -------------------------------------------------------------------------------------------

def p3_found(spark: SparkSession, d: str) -> DataFrame:
    trades = load(spark, d, "non_cross_trade").where("stock_locate IS NOT NULL").select("trade_id", "session_date", "stock_locate", "ts_ns")
    quotes = load(spark, d, "bbo").where("has_bid")
    pairs = nearest(trades, quotes, ["session_date", "stock_locate"], "ts_ns", "bbo_id", TOLERANCE_NS)
    return pairs.where("nearest_id IS NOT NULL").select("trade_id", F.col("nearest_id").alias("bbo_id")).distinct()


# 8 -------------------------------------------------------------------------------------------

def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.with_ids(load(spark, d, "documents"), ["doc_id"])


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """The texts again, from the ids."""
    return tokens.with_texts(p8_ids(spark, d), ["doc_id"])


# 9 -------------------------------------------------------------------------------------------

def _mix(spark: SparkSession, d: str):
    counts = materialize(tokens.with_counts(load(spark, d, "documents"), ["doc_id", "source"]), "counts")
    targets = load(spark, d, "mix_target")
    return mixing.mix(counts, targets), counts, targets


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0].rows


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    m, counts, targets = _mix(spark, d)
    return mixing.shares(m.rows, counts, targets)


def p9_promises(spark: SparkSession, d: str) -> DataFrame:
    """Per source of the mix: no document's tokens come more often than the cap, every block is whole
    and comes from one source, and the tokens differ from the share by less than ``NEAR`` blocks a repeat."""
    m, _, targets = _mix(spark, d)
    rows = materialize(m.rows, "mix")
    caps = targets.groupBy(mixing.normal_source("source").alias("source")).agg(F.sum("target_share").alias("w"), F.min(F.coalesce("max_repeats", F.lit(1))).alias("cap"))
    # a token's uses: its document's spans that hold it, one row a span and repeat
    used = rows.groupBy("source", "doc", "block", "token_from", "token_to").agg(F.count(F.lit(1)).alias("uses")).groupBy("source").agg(F.max("uses").alias("uses"))
    # tokens stand side by side in the slots, none twice at a place
    slots = rows.groupBy("source", "shard", "slot").agg(F.sum(F.expr("token_to - token_from")).alias("n"), F.max(F.expr("at + token_to - token_from")).alias("end"))
    sizes = slots.groupBy("source").agg(F.sum("n").alias("n"), F.min(F.col("n") == F.col("end")).alias("whole"))
    everything = Window.partitionBy(F.lit(1))  # at most one row a target
    got = sizes.join(used, "source").join(caps, "source")
    near = F.abs(F.col("n") - F.col("w") / F.sum("w").over(everything) * F.sum("n").over(everything)) <= NEAR * mixing.BLOCK_TOKENS * F.col("cap")
    return got.select("source", (F.col("uses") <= F.col("cap")).alias("within_cap"), "whole", near.alias("near_share"))


# 10 ------------------------------------------------------------------------------------------

def _stuffed(spark: SparkSession, d: str) -> DataFrame:
    docs = load(spark, d, "documents")
    return stuffing.score(docs, "doc_id", stuffing.train(docs, "doc_id"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _stuffed(spark, d).where(F.col("stuffed_share") > 0.5).select("doc_id")


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    return _stuffed(spark, d)


_MADE = """
    SELECT s_suppkey AS doc_id, CASE s_suppkey % 6
      WHEN 0 THEN array_join(transform(sequence(1, 40), i -> concat('* http://made', s_suppkey * i, '.test/p?id=', i)), '\\n')
      WHEN 1 THEN array_join(transform(sequence(1, 40), i -> concat('* [[', s_name, ' ', i, ']]')), '\\n')
      WHEN 2 THEN array_join(transform(sequence(1, 60), i -> concat('#', element_at(goods, pmod(hash(i, s_suppkey), 8) + 1), element_at(goods, pmod(hash(i, s_suppkey, 1), 8) + 1))), ' ')
      WHEN 3 THEN array_join(transform(sequence(1, 20), i -> concat('The old mill of ', s_name, ' was first described in ', 1500 + i, ' and has been moved to the harbour since.')), '\\n')
      WHEN 4 THEN array_join(transform(sequence(1, 90), i -> concat(element_at(goods, pmod(hash(i, s_suppkey), 8) + 1), ' ', element_at(goods, pmod(hash(i, s_suppkey, 1), 8) + 1), if(i % 7 = 0, ',', ''))), ' ')
      ELSE concat('#REDIRECT [[', s_name, ']]') END AS text
    FROM (SELECT *, array('zorgol', 'plindex', 'gizmar', 'blorpine', 'quaffet', 'snarfle', 'drimbo', 'fozzle') AS goods FROM {supplier})
"""


def p10_made(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are links, tags or keywords, or a list, sentences or a redirect, by construction, scored
    by the model of the documents."""
    pages = spark.sql(_MADE, supplier=load(spark, d, "supplier"))
    shares = stuffing.score(pages, "doc_id", stuffing.train(load(spark, d, "documents"), "doc_id"))
    return shares.select("doc_id", (F.col("stuffed_share") > 0.5).alias("stuffed"))


QUERIES = {f.__name__: f for f in (p2_percentiles, p2_within_bound, p2_coarse_within_bound, p3_found, p8_ids, p8_decoded, p9_mix, p9_shares, p9_promises, p10_found, p10_shares, p10_made)}

_METRICS_2 = "(SELECT stock_locate, 'price' AS metric, price AS value FROM add_order UNION ALL SELECT stock_locate, 'shares', shares FROM add_order)"

ORACLES = {
    "p10_made": "SELECT s_suppkey AS doc_id, s_suppkey % 6 IN (0, 2, 4) AS stuffed FROM supplier",
    "p8_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p9_promises": """
      SELECT DISTINCT lower(trim(t.source)) AS source, true AS within_cap, true AS whole, true AS near_share FROM mix_target t
      JOIN documents d ON lower(trim(d.source)) = lower(trim(t.source)) WHERE t.target_share > 0 AND coalesce(t.max_repeats, 1) > 0 AND d.text <> ''""",
    "p2_coarse_within_bound": f"""
      SELECT stock_locate, metric, count(*) AS n, CAST(3 AS BIGINT) AS n_percentiles, true AS within_bound, true AS small, count(*) >= 640 AS folded
      FROM {_METRICS_2} WHERE value IS NOT NULL GROUP BY stock_locate, metric""",
    # groups of fewer than 32,000 rows are not folded and so exact, which all are where this is compared
    "p2_percentiles": f"""
      WITH c AS (SELECT stock_locate, metric, least(greatest(value, 0), 4294967295) AS value FROM {_METRICS_2} WHERE value IS NOT NULL),
      r AS (SELECT *, row_number() OVER (PARTITION BY stock_locate, metric ORDER BY value) AS k, count(*) OVER (PARTITION BY stock_locate, metric) AS n FROM c)
      SELECT stock_locate, metric, p, min(value) AS percentile, n, 32 * (n // 32000) AS max_rank_error
      FROM r, (SELECT unnest([CAST(0.01 AS DOUBLE), 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]) AS p) WHERE k >= greatest(1, ceil(p * n)) GROUP BY stock_locate, metric, p, n""",
    "p2_within_bound": """
      SELECT stock_locate, metric, count(*) AS n, CAST(7 AS BIGINT) AS n_percentiles, true AS within_bound
      FROM (SELECT stock_locate, 'price' AS metric, price AS value FROM add_order UNION ALL SELECT stock_locate, 'shares', shares FROM add_order)
      WHERE value IS NOT NULL GROUP BY stock_locate, metric""",
    "p3_found": f"""
      SELECT trade_id, bbo_id FROM (
        SELECT t.trade_id, b.bbo_id, row_number() OVER (PARTITION BY t.trade_id ORDER BY abs(b.ts_ns - t.ts_ns), b.ts_ns, b.bbo_id) AS k
        FROM (SELECT DISTINCT trade_id, session_date, stock_locate, ts_ns FROM non_cross_trade) t JOIN bbo b
          ON t.session_date = b.session_date AND t.stock_locate = b.stock_locate AND b.has_bid AND abs(b.ts_ns - t.ts_ns) <= {TOLERANCE_NS}) WHERE k = 1""",
}
