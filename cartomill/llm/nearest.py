"""Exact nearest neighbours by a block matrix join.

Candidates are dealt into groups of about GROUP_ROWS rows; the query set is
packed into blocks, and each block meets each group once.  A tile of int8
products gives squared distances with a bound on the quantisation error; pairs
whose lower bound beats the query's k-th upper bound survive and are computed
anew in double precision.  Each tile's k best go on, and heaps merge them.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartomill.llm.common import ship, table

GROUP_ROWS = 4096
BLOCK_ROWS = 512
FOUND = "query_id long, vec_id long, score double"


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scale, norm of what the codes stand for, norm of the rest; one scale for each row."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    stood = codes * scale[:, None]
    return codes, scale, np.sqrt((stood * stood).sum(1)), np.sqrt(((x - stood) ** 2).sum(1))


def tile(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple[int, int, float]]:
    """The k nearest rows of ``c`` for each row of ``q``, the own id apart; ties to the smaller id."""
    (qc, qs, qn, qe), (cc, cs, cn, ce) = _quantised(q), _quantised(c)
    # sums of int8 products stay below 2**24 up to 1,040 dimensions: float32 holds them exactly
    wide = np.float32 if q.shape[1] <= 1040 else np.float64
    product = (qc.astype(wide) @ cc.astype(wide).T) * qs[:, None] * cs[None]
    error = qn[:, None] * ce[None] + qe[:, None] * (cn + ce)[None]
    middle = (q * q).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * product
    slack = 2 * error * (1 + 1e-9) + 1e-9 * (np.abs(middle) + 1)
    own = qid[:, None] == cid[None]
    upper = np.where(own, np.inf, middle + slack)
    limit = np.partition(upper, min(k, upper.shape[1]) - 1, axis=1)[:, min(k, upper.shape[1]) - 1]
    alive = ~own & (middle - slack <= limit[:, None])
    for i in range(len(qid)):
        at = np.flatnonzero(alive[i])
        exact = np.sqrt(np.add.accumulate((c[at] - q[i]) ** 2, axis=1)[:, -1])  # summed in order, as SQL does
        for j in np.lexsort((cid[at], exact))[:k]:
            yield int(qid[i]), int(cid[at[j]]), float(exact[j])


def _tiles(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by group, candidates first; holds one group of candidates and one block of queries."""
    group, ids, vecs, packed = None, [], [], None
    for b in batches:
        cols = [b.column(i) for i in range(5)]
        for g, block, dim, i, v in zip(*(x.to_pylist() if n != 4 else x for n, x in enumerate(cols)), strict=True):
            if g != group:
                group, ids, vecs, packed = g, [], [], None
            rows = np.frombuffer(v.as_buffer(), np.float64).reshape(-1, dim)
            own = np.frombuffer(i, np.int64)
            if block < 0:
                ids.append(own)
                vecs.append(rows)
                continue
            if not ids:
                continue
            packed = packed or (np.concatenate(ids), np.concatenate(vecs))
            if out := list(tile(own, rows, *packed, k)):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], ["query_id", "vec_id", "score"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, block, dim, id, vector), sorted by group and block, as binary blocks of BLOCK_ROWS."""
    names = ["group", "block", "dim", "ids", "vectors"]
    key, ids, vecs = None, [], []

    def out() -> pa.RecordBatch:
        row = [*key, np.array(ids, np.int64).tobytes(), np.array(vecs, np.float64).tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names)

    for b in batches:
        for g, block, dim, i, v in zip(*(b.column(n).to_pylist() for n in range(5)), strict=True):
            if key != (g, block, dim) or len(ids) >= BLOCK_ROWS:
                if ids:
                    yield out()
                key, ids, vecs = (g, block, dim), [], []
            ids.append(i)
            vecs.append(v)
    if ids:
        yield out()


def _merged(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by query: a heap of the k best, the worst on top."""
    query, heap = None, []

    def out() -> pa.RecordBatch:
        best = sorted((-d, -i) for d, i in heap)
        return pa.RecordBatch.from_arrays(
            [pa.array([query] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()), pa.array([i for _, i in best], pa.int64()), pa.array([d for d, _ in best], pa.float64())],
            ["query_id", "rank", "vec_id", "score"],
        )

    for b in batches:
        for q, i, d in zip(*(b.column(n).to_pylist() for n in range(3)), strict=True):
            if q != query:
                if heap:
                    yield out()
                query, heap = q, []
            if len(heap) < k:
                heapq.heappush(heap, (-d, -i))
            elif (-d, -i) > heap[0]:
                heapq.heapreplace(heap, (-d, -i))
    if heap:
        yield out()


def sound(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """Vectors that take part: not null, zero or empty, without null or non-finite components."""
    x = F.col(vec_col).cast("array<double>")
    kept = vectors.select(F.col(id_col).alias("vec_id"), x.alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0")
    return kept.where(~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))).where(F.exists("vec", lambda v: v != 0))


def nearest(candidates: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Both: (vec_id, vec array<double>) as from sound().  Result: (query_id, rank, vec_id, score).

    Vectors of another length are never compared.  A row with the query's id is the
    query itself; a repeated candidate is a candidate as often; repeated queries
    count once.  Fewer than k candidates: all of them.
    """
    spark = candidates.sparkSession
    ship(spark)
    groups = max(1, -(-candidates.count() // GROUP_ROWS))
    queries = queries.dropDuplicates(["vec_id"])
    blocks = max(1, -(-queries.count() // BLOCK_ROWS))
    dim = F.size("vec").alias("dim")
    dealt = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.lit(groups)) * 65536 + F.size("vec")
    mine = candidates.select(dealt.alias("group"), F.lit(-1).cast("long").alias("block"), dim, "vec_id", "vec")
    names = "group long, block long, dim int, ids binary, vectors binary"

    def pack(df: DataFrame) -> DataFrame:
        return df.repartition(max(1, groups if df is mine else blocks), "group", "block").sortWithinPartitions("group", "block").mapInArrow(_packed, names)

    asked = queries.select(F.size("vec").cast("long").alias("group"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).alias("block"), dim, "vec_id", "vec")
    every = F.transform(F.sequence(F.lit(0), F.lit(groups - 1)), lambda g: g.cast("long") * 65536)
    spread = pack(asked).withColumn("g", F.explode(every)).select((F.col("g") + F.col("group")).alias("group"), "block", "dim", "ids", "vectors")
    met = pack(mine).unionByName(spread).repartition(groups, "group").sortWithinPartitions("group", "block")
    found = met.mapInArrow(lambda it: _tiles(it, k), FOUND)
    return found.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(lambda it: _merged(it, k), "query_id long, rank int, vec_id long, score double")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = sound(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return nearest(every, every.where("vec_id % 100 = 0"))


OP10_SQL = """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, c.vec_id, sqrt(list_sum(list_transform(list_zip(q.e, c.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])))) AS score
  FROM (SELECT DISTINCT ON (vec_id) * FROM v WHERE vec_id % 100 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
