"""Helpers that the training-data operators share: input, shared scratch tables, ids."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartomill import storage
from cartomill.storage import discard, scratch, written

__all__ = ["discard", "having", "lacking", "join_hot", "let", "perhaps", "remainder", "scratch", "ship", "table", "words", "written"]

#: A word is a run of characters other than the six ASCII white-space ones.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """storage.ship(), and Arrow batches of whole texts of ARROW_ROWS rows where the session has Spark's default of 10,000.

    Results are run by the caller, so the setting can't be undone before; a session that names a number of its own keeps it.
    """
    storage.ship(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def words(text: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once for a row even where a lambda in body uses it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, mod n; a null id counts as an empty text, whose remainder is 0."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


#: Broadcast filters hold at most this many bucket numbers, whatever the number of keys.
FILTER_BUCKETS = 1 << 18


def _bucket(key: str) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(13)), F.lit(FILTER_BUCKETS)).alias("_bucket")


def perhaps(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` may be in ``keys``: a broadcast of bounded size keeps most others out of a shuffle."""
    few = F.broadcast(keys.select(_bucket(key)).distinct())
    return rows.withColumn("_bucket", _bucket(key)).join(few, "_bucket", "left_semi").drop("_bucket")


def having(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose non-null ``key`` is in ``keys``."""
    return perhaps(rows, keys, key).join(keys.select(key).distinct(), key, "left_semi").select(rows.columns)


def lacking(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is not in ``keys``, null ones included; only those that may be are shuffled."""
    few = F.broadcast(keys.select(_bucket(key)).distinct())
    marked = rows.withColumn("_bucket", _bucket(key))
    far = marked.join(few, "_bucket", "left_anti").drop("_bucket")
    near = marked.join(few, "_bucket", "left_semi").drop("_bucket")
    return far.unionByName(near.join(keys.select(key).distinct(), key, "left_anti").select(rows.columns))


#: Groups of more rows than this, and than a 100,000th of all rows, are joined by a broadcast of at most 100,000 rows.
HOT_ROWS, HOT_GROUPS = 1000, 100_000


def join_hot(rows: DataFrame, groups: DataFrame, by: list[str], n: str = "n") -> DataFrame:
    """``rows`` joined with ``groups`` (by, ``n``: rows in the group, any others): large groups aren't shuffled to one task.

    Both should be tables that are cheap to read again.
    """
    large = F.broadcast(groups.where(F.col(n) > max(HOT_ROWS, rows.count() // HOT_GROUPS)))
    return rows.join(large, by).unionByName(rows.join(large.select(by), by, "left_anti").join(groups, by))
