"""Sharding by a k-d tree over document metadata, in DataFrame operations only.

A node that must yield k leaves is cut at the weighted (by bytes) quantile
floor(k/2)/k of its widest metadata dimension: language, source or size.  A
category is as wide as the share of all its values that the node holds, the size
as the share of its range.  Each dimension is one non-negative 62-bit integer:
the metadata value (a category's hash), then 16 bits
of the text's hash, then 16 of the id's.  So a value that a third of all rows
share can still be cut, equal texts lie side by side, and a group of them is
cut only where it is too heavy for the balance.  Quantiles are found by
distributed histograms that zoom into the bin on which the quantile falls;
only these histograms (at most leaves x 1024 rows) reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartomill.llm.common import discard, join_hot, table, written

DIMENSIONS = ("lang", "source", "bytes")
#: Histogram bins are values shifted by these, one after the other; 32 bits below are hash bits.
SHIFTS = (52, 42, 32, 24, 16, 8, 0)
LOW, TOP = 32, 1 << 62
#: A cut is good when it misses the quantile by this share of a leaf; by the second, if zooming on would divide equal texts.
TOLERANCE, GROUP_TOLERANCE = 0.001, 0.01
#: Rows of a shard whose slots one task numbers.
SLOT_ROWS = 2048


@dataclass
class Node:
    leaves: int
    first: int
    dim: int = 0
    base: int = 0
    cut: int = 0
    want: float = 0.0
    leaf: float = 0.0
    below: float = 0.0
    done: bool = True


def metadata(docs: DataFrame) -> DataFrame:
    """One row for each document, without its text.  A null text has no bytes and the crc32 of none, 0."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        "doc_id", "lang", "source", (F.octet_length(raw) + 8).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("text_hash")
    )


def _dimensioned(meta: DataFrame) -> DataFrame:
    """Copies of a text take lang and source of the copy with the least doc_id, so that they lie together."""
    group = ["text_hash", "text_crc32", "size"]
    meta = written(meta, "meta")
    first = meta.groupBy(*group).agg(F.min(F.struct("doc_id", "lang", "source")).alias("_kd_first"), F.count("*").alias("_kd_n"))
    first = written(first, "groups")
    bits = lambda c, n: F.xxhash64(c).bitwiseAND(F.lit((1 << n) - 1))
    low = F.shiftleft(bits(F.col("text_hash"), 16), 16).bitwiseOR(bits(F.col("doc_id"), 16))
    value = {
        "lang": bits(F.col("_kd_first.lang"), 30),
        "source": bits(F.col("_kd_first.source"), 30),
        "bytes": F.least((F.log(F.col("size").cast("double")) * 2.0e7).cast("long"), F.lit((1 << 30) - 1)),
    }
    return join_hot(meta, first, group, "_kd_n").select(meta.columns + [F.shiftleft(v, LOW).bitwiseOR(low).alias(f"_kd_dim_{k}") for k, v in value.items()])


def _value() -> Column:
    """The dimension that the row's node is cut in.  Nodes' choices come from a joined table, so all rounds run the same code."""
    return F.when(F.col("_kd_dim") == 0, F.col("_kd_dim_lang")).when(F.col("_kd_dim") == 1, F.col("_kd_dim_source")).otherwise(F.col("_kd_dim_bytes"))


def _table(rows: DataFrame, values: list[tuple[int, ...]], names: str) -> DataFrame:
    """As many rows as there are nodes, at most one for each shard."""
    listed = ", ".join("(" + ", ".join(f"{v}L" for v in row) + ")" for row in values)
    return F.broadcast(rows.sparkSession.sql(f"SELECT * FROM VALUES {listed} AS t({', '.join(names.split())})"))


def _width(dim: str) -> list[Column]:
    """How wide the rows are in the dimension: least and greatest size, or number of distinct values."""
    value = F.shiftright(f"_kd_dim_{dim}", LOW)
    if dim == "bytes":
        return [F.min(value).alias("lo_bytes"), F.max(value).alias("hi_bytes")]
    return [F.lit(1).alias(f"lo_{dim}"), F.approx_count_distinct(value, 0.02).alias(f"hi_{dim}")]


def _cut(rows: DataFrame, nodes: list[Node], width: dict[str, float]) -> None:
    """Finds each node's widest dimension and its cut."""
    live = rows.where("_kd_node >= 0")
    ranges = live.groupBy("_kd_node").agg(F.sum("size").alias("w"), *[c for d in DIMENSIONS for c in _width(d)])
    for r in ranges.collect():
        n = nodes[r["_kd_node"]]
        spread = [(r[f"hi_{d}"] - r[f"lo_{d}"]) / width[d] for d in DIMENSIONS]
        n.dim, n.done = max(range(len(DIMENSIONS)), key=lambda d: spread[d]), False
        n.want, n.leaf = r["w"] * (n.leaves // 2) / n.leaves, r["w"] / n.leaves
    above = 62
    for shift in SHIFTS:
        todo = [(i, n.dim, n.base >> above, above, shift) for i, n in enumerate(nodes) if not n.done]
        if not todo:
            break
        near = live.join(_table(rows, todo, "_kd_node _kd_dim _kd_base _kd_above _kd_shift"), "_kd_node").withColumn("_kd_key", _value())
        near = near.where(F.call_function("shiftright", F.col("_kd_key"), F.col("_kd_above").cast("int")) == F.col("_kd_base"))
        bins = near.groupBy("_kd_node", F.call_function("shiftright", F.col("_kd_key"), F.col("_kd_shift").cast("int")).alias("bin")).agg(F.sum("size").alias("w")).collect()
        found: dict[int, list] = {}
        for r in sorted(bins, key=lambda r: r["bin"]):
            found.setdefault(r["_kd_node"], []).append(r)
        for i, n in enumerate(nodes):
            for r in found.get(i, ()):
                if n.below + r["w"] < n.want:
                    n.below += r["w"]
                    continue
                short, over = n.want - n.below, n.below + r["w"] - n.want
                n.base = r["bin"] << shift
                n.cut = n.base if short <= over else (r["bin"] + 1) << shift
                n.done = min(short, over) <= n.leaf * (TOLERANCE if shift != 16 else GROUP_TOLERANCE)
                break
        above = shift


def kd_shards(meta: DataFrame, shards: int = 24) -> DataFrame:
    """``meta`` (from metadata(); any further columns but _kd_ ones) with shard 0 to shards-1, near equal in bytes.

    Null lang or source: a value of its own.  Repeated rows and ties: told apart by the
    id's hash, else they stay together.  Fewer rows than shards: some shards stay empty.
    An empty table gives an empty result.
    """
    rows = written(_dimensioned(meta).withColumn("_kd_node", F.lit(0 if shards > 1 else -1).cast("long")), "kd")
    whole = rows.agg(*[c for d in DIMENSIONS for c in _width(d)]).first()
    width = {d: max(1, (whole[f"hi_{d}"] or 0) - (whole[f"lo_{d}"] or 0)) for d in DIMENSIONS}
    level = [Node(shards, 0)] if shards > 1 else []
    while level:
        _cut(rows, level, width)
        parents = level
        kids = [k for n in level for k in (Node(n.leaves // 2, n.first), Node(n.leaves - n.leaves // 2, n.first + n.leaves // 2))]
        level, number, of = [], 0, []
        for k in kids:
            of.append(number if k.leaves > 1 else -1 - k.first)
            if k.leaves > 1:
                level.append(k)
                number += 1
        values = [(i, n.dim, n.cut, of[2 * i], of[2 * i + 1]) for i, n in enumerate(parents)]
        side = F.when(F.col("_kd_dim").isNull(), F.col("_kd_node")).when(_value() < F.col("_kd_cut"), F.col("_kd_low")).otherwise(F.col("_kd_high"))
        moved = rows.join(_table(rows, values, "_kd_node _kd_dim _kd_cut _kd_low _kd_high"), "_kd_node", "left").withColumn("_kd_node", side)
        old, rows = rows, written(moved.select(rows.columns), "kd")
        discard(old)
    return rows.withColumn("shard", (-1 - F.col("_kd_node")).cast("int")).drop("_kd_node", *[f"_kd_dim_{d}" for d in DIMENSIONS])


def numbered(rows: DataFrame, key: str = "doc_id", shards: int = 24) -> DataFrame:
    """Adds slot: numbers without gaps from 0 within each shard, by two levels of counts."""
    parts = max(1, rows.count() // (shards * SLOT_ROWS))
    rows = rows.withColumn("_kd_part", F.pmod(F.xxhash64(key), F.lit(parts)))
    before = W.partitionBy("shard").orderBy("_kd_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = rows.groupBy("shard", "_kd_part").count().select("shard", "_kd_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_kd_off"))
    within = W.partitionBy("shard", "_kd_part").orderBy(key)
    return rows.withColumn("_kd_in", F.row_number().over(within) - 1).join(offsets, ["shard", "_kd_part"]).withColumn("slot", F.col("_kd_off") + F.col("_kd_in")).drop("_kd_part", "_kd_in", "_kd_off")


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = numbered(kd_shards(metadata(table(spark, sf_dir, "documents"))))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their size, shard and slot: the last stage.  Copies of a document are numbered apart."""
    return numbered(kd_shards(metadata(docs))).select("doc_id", "lang", "source", "size", "text_crc32", "shard", "slot")
