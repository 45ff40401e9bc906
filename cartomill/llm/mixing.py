"""Mixing sources to target weights.

Every document gets a hash-random key; documents are range-sorted by it within
their source, prefix sums of the token counts are computed in two levels (per
key range, then within it), and each source is cut at its budget.  Whole
passes over the source (epochs) come first where the budget exceeds its size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartomill.llm.common import discard, table, words, written

#: Documents that one key range of a source is meant to hold.
RANGE_ROWS = 2048
#: Sources whose cuts are broadcast at most; beyond, they are joined by source.
BROADCAST_SOURCES = 100_000


def _key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def mix(
    sized: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
    id_col: str = "doc_id",
) -> DataFrame:
    """Adds source_size, target, taken and copies to ``sized`` (id, source, size long, any others).

    Targets: sources in code-point order (null last) weigh ``weights`` in turn
    and share ``share`` times the total; none gets over ``cap`` times its size,
    and the excess goes to the others by weight.  A document is taken whole
    ``copies`` times; the one on which the cut falls is taken if that comes
    nearer to the target.  Documents of size 0 count as taken with 0 words and
    are in as many copies as their place in the order gives.  Repeated rows and
    ties of the key are ordered by id and size, so reruns agree.  An empty table
    gives an empty result.
    """
    rows = sized.count()
    digits = 0
    while 16**digits * RANGE_ROWS < rows:
        digits += 1
    keyed = sized.withColumns(
        {
            "_key": _key(F.col(id_col), seed),
            "_null": F.col("source").isNull(),
            "_src": F.coalesce(F.col("source"), F.lit("")),
        }
    ).withColumn("_range", F.substring("_key", 1, digits))
    sums = keyed.groupBy("_null", "_src", "_range").agg(F.sum("size").alias("_sum"))
    targets = _targets(sums.groupBy("_null", "_src").agg(F.sum("_sum").alias("source_size")), weights, share, cap)
    before = W.partitionBy("_null", "_src").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_null", "_src", "_range", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    within = W.partitionBy("_null", "_src", "_range").orderBy("_key", id_col, "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("_off") + F.col("_in")
    full = F.floor(F.col("target") / F.col("source_size"))
    left = F.col("target") - F.col("_full") * F.col("source_size")
    return (
        keyed.withColumn("_in", F.coalesce(F.sum("size").over(within), F.lit(0)))
        .join(offsets, ["_null", "_src", "_range"])
        .join(targets, ["_null", "_src"])
        .withColumn("_full", F.when(F.col("source_size") > 0, full).otherwise(0))
        .withColumn("copies", (F.col("_full") + F.when(2 * (left - start) >= F.col("size"), 1).otherwise(0)).cast("int"))
        .withColumn("copies", F.least("copies", F.lit(int(cap))))
        .withColumn("taken", F.col("copies").cast("long") * F.col("size"))
        .drop("_key", "_null", "_src", "_range", "_in", "_off", "_full")
    )


def _targets(sources: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """Water filling in one pass: sources that fill first (cap / weight ascending) get their cap."""
    every = W.orderBy("_null", "_src")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    fill = W.orderBy("_level", "_null", "_src")
    up_to, after = fill.rowsBetween(W.unboundedPreceding, -1), fill.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    return (
        sources.withColumn("_rank", F.row_number().over(every) - 1)
        .withColumn("_w", weight)
        .withColumn("_cap", cap * F.col("source_size").cast("double"))
        .withColumn("_level", F.col("_cap") / F.col("_w"))
        .withColumn("_budget", share * F.sum("source_size").over(whole))
        .withColumn("_lambda", (F.col("_budget") - F.coalesce(F.sum("_cap").over(up_to), F.lit(0.0))) / F.sum("_w").over(after))
        .withColumn("_open", F.when(F.col("_lambda") <= F.col("_level"), F.col("_lambda")))
        .withColumn("_lambda", F.coalesce(F.max("_open").over(whole), F.lit(float("inf"))))
        .select("_null", "_src", "source_size", F.least("_cap", F.col("_w") * F.col("_lambda")).alias("target"))
    )


def sized(docs: DataFrame, text: Column | None = None) -> DataFrame:
    """The columns that mix() needs, without the text."""
    return docs.select("doc_id", "source", words(F.col("text") if text is None else text).alias("size"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = written(sized(table(spark, sf_dir, "documents")), "mix")
    return mix(small).select("doc_id", "size", "source_size", "target", "taken")


def cuts(plan: DataFrame, seed: str = "mix") -> DataFrame:
    """mix()'s decision as one row for each source: copies of its documents up to the key ``_mix_last``, and of the others.

    The documents taken once more are the first ones of the source's order, so the last of
    them tells all.
    """
    order = F.struct(_key(F.col("doc_id"), seed).alias("key"), "doc_id", "size")
    both = plan.groupBy("source", "copies").agg(F.max(order).alias("last"))
    ends = [F.max("copies").alias("_mix_most"), F.min("copies").alias("_mix_least"), F.max_by("last", "copies").alias("_mix_last")]
    return both.groupBy(F.col("source").alias("_mix_source")).agg(*ends)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mixture takes it.  Only ids and sizes are sorted; texts don't move.

    Columns that start with _mix_ are reserved; any others pass through.
    """
    small = written(sized(docs), "mix")
    ends = written(cuts(mix(small)), "cuts")
    few = F.broadcast(ends) if ends.count() <= BROADCAST_SOURCES else ends
    order = F.struct(_key(F.col("doc_id"), "mix").alias("key"), "doc_id", words(F.col("text")).alias("size"))
    met = docs.join(few, F.col("source").eqNullSafe(F.col("_mix_source")))
    often = met.withColumn("_mix_n", F.when(order <= F.col("_mix_last"), F.col("_mix_most")).otherwise(F.col("_mix_least"))).where("_mix_n > 0")
    out = often.withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_n")))).select(docs.columns)
    discard(small)
    return out


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w FROM d GROUP BY source),
c AS (SELECT *, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget FROM s),
f AS (
  SELECT a.source, (a.budget - coalesce(sum(b.cap) FILTER (b.cap / b.w < a.cap / a.w), 0))
         / sum(b.w) FILTER (b.cap / b.w >= a.cap / a.w) AS lam, a.cap / a.w AS lev
  FROM c a, c b GROUP BY a.source, a.budget, a.cap, a.w),
t AS (
  SELECT source, source_size, least(cap, w * (SELECT max(lam) FROM f WHERE lam <= lev)) AS target FROM c),
p AS (
  SELECT doc_id, source, size,
         coalesce(sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d)
SELECT doc_id, size, source_size, target,
       CAST(size * least(2, floor(target / source_size)
            + CASE WHEN 2 * (target - floor(target / source_size) * source_size - before) >= size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source
"""
