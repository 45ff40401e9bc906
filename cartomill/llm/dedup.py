"""Near-duplicate classes by MinHash: consistent weighted sampling over TF-IDF shingles, bands, verified links.

1. Shares of documents are counted exactly for every five-word shingle that is
   in over FREQUENT of them; the others have the same, largest, weight.
2. Each text is sampled and banded.  Equal texts are one node.
3. Within each bucket (texts that share a band) every text is compared with the
   bucket's pivot.  In buckets that still hold several components, pairs between
   components follow whose rarest shingles meet, except those that the weights
   or the triangle inequality of the weighted Jaccard distance rule out.  Each
   compared pair is verified on the whole texts.
4. Links of similarity SIMILAR and above form classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cartomill.llm.common import discard, having, join_hot, lacking, perhaps, ship, table, written
from cartomill.llm.components import components
from cartomill.llm.minhash import FREQUENT, SKETCH, Weights, bands, jaccard, shingles, sketch

SIMILAR = 0.8
#: Texts that are compared with one copy of a pivot's text.
CHUNK = 64
#: Shingles of a batch in which they are counted.
COUNTED = 4_000_000
#: Counters, of hash values, that rule out rare shingles; and the shards in which they are summed.
COUNTERS, SHARDS = 1 << 20, 16
#: Pairs between components are spared if their sketches say less than this: six standard deviations (a chance of 1e-9) below SIMILAR.
SKETCHED = 0.62


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, text): key is the text's MD5; null texts are left out."""
    return docs.where("text is not null").select("doc_id", F.unhex(F.md5(F.col("text").cast("binary"))).alias("key"), "text")


def _unique(texts: pa.Array) -> np.ndarray:
    """Each text's distinct shingles, one text behind the other."""
    return np.concatenate([np.zeros(0, np.uint64), *[np.unique(x) for x in shingles(texts)]])


def weights(texts: DataFrame) -> Weights:
    """Of all documents (column text, not null).

    Every shingle of every document counts in one of COUNTERS counters.  Only those whose
    counter passes FREQUENT of all documents can be that frequent; a second pass counts
    these exactly.  What reaches the driver is bounded: the counters' numbers, and at most
    1 / FREQUENT times a document's mean number of shingles.
    """
    ship(texts.sparkSession)
    span = COUNTERS // SHARDS

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(COUNTERS, np.int32), 0
        for b in batches:
            total += np.bincount((_unique(b.column(0)) & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS).astype(np.int32)
            rows += b.num_rows
        if rows:
            part = [total[i * span : (i + 1) * span].tobytes() for i in range(SHARDS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(SHARDS), pa.int64()), pa.array(part, pa.binary()), pa.array([rows] + [0] * (SHARDS - 1), pa.int64())], ["shard", "n", "docs"])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        docs = 0
        for b in batches:
            for shard, n, d in zip(*(c.to_pylist() for c in b.columns), strict=True):
                held[shard] = held.get(shard, 0) + np.frombuffer(n, np.int32).astype(np.int64)
                docs += d
        for shard, n in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([n.tobytes()], pa.binary()), pa.array([docs])], ["shard", "n", "docs"])
            docs = 0

    schema = "shard long, n binary, docs long"
    sums = written(texts.mapInArrow(counted, schema).repartition(SHARDS, "shard").mapInArrow(summed, schema), "counters")
    total = sums.agg(F.sum("docs")).first()[0] or 0
    floor = min(1.0, max(FREQUENT, 2 / max(1, total)))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(np.frombuffer(n, np.int64) > floor * total).tobytes() for n in b.column("n").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(bits, pa.binary())], ["shard", "bits"])

    may = np.zeros(COUNTERS, bool)
    for r in sums.select("shard", "n").mapInArrow(passed, "shard long, bits binary").collect():
        may[r["shard"] * span : (r["shard"] + 1) * span] = np.unpackbits(np.frombuffer(r["bits"], np.uint8))
    discard(sums)
    if not may.any():
        return Weights(np.zeros(0, np.uint64), np.zeros(0), floor)
    held = texts.sparkSession.sparkContext.broadcast(np.packbits(may))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, kept, size = np.unpackbits(held.value).astype(bool), [], 0

        def out() -> pa.RecordBatch:
            s, n = np.unique(np.concatenate(kept), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(s.view(np.int64)), pa.array(n)], ["s", "n"])

        for b in batches:
            s = _unique(b.column(0))
            kept.append(s[m[(s & np.uint64(COUNTERS - 1)).astype(np.int64)]])
            size += len(kept[-1])
            if size >= COUNTED:
                yield out()
                kept, size = [], 0
        if size:
            yield out()

    rows = texts.mapInArrow(exact, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") > floor * total).toArrow()
    held.destroy()
    return Weights(rows.column("s").to_numpy().view(np.uint64), rows.column("n").to_numpy() / total, floor)


def _banded(keyed: DataFrame, model) -> DataFrame:
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            total, keys = [], []
            for i in range(0, b.num_rows, 200):
                bags = [w.bag(x) for x in shingles(b.column("text").slice(i, 200))]
                total += [float(x[1].sum(dtype=np.float64)) for x in bags]
                keys += [k.tolist() for k in bands(bags)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(total, pa.float64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "key", "weight", "bands"])

    return keyed.mapInArrow(sample, "doc_id long, key binary, weight double, bands array<bigint>")


def _texts(keyed: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, text) of ``keys`` (key, distinct): one row for each text, however many copies it has, is shuffled."""
    return perhaps(keyed.select("key", "text"), keys, "key").dropDuplicates(["key"]).join(keys, "key", "left_semi")


def _verified(pairs: DataFrame, keyed: DataFrame, model) -> DataFrame:
    """(p, key, sim) of ``pairs`` (p, key), from the whole texts.

    Pairs of a pivot are dealt into chunks, each with its own copy of the pivot's text.
    """
    pairs = written(pairs.distinct(), "pairs")
    texts = written(_texts(keyed, pairs.select(F.col("p").alias("key")).unionByName(pairs.select("key")).distinct()), "texts")
    chunks = pairs.groupBy("p").agg(F.ceil(F.count("*") / CHUNK).alias("chunks"))
    dealt = written(pairs.join(chunks, "p").select("p", "key", F.pmod(F.xxhash64("key", F.lit(3)), F.col("chunks")).alias("chunk")), "dealt")
    pivots = dealt.select("p", "chunk").distinct().join(texts.withColumnRenamed("key", "p"), "p").select("p", "chunk", F.lit(None).cast("binary").alias("key"), "text")
    others = dealt.join(texts, "key").select("p", "chunk", "key", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, own, bag = model.value, None, None
        for b in batches:
            out = []
            for p, key, x in zip(b.column("p").to_pylist(), b.column("key").to_pylist(), shingles(b.column("text")), strict=True):
                if key is None:
                    own, bag = p, w.bag(x)
                else:
                    assert own == p
                    out.append((p, key, jaccard(bag, w.bag(x))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.binary(), pa.float64()), strict=True)], ["p", "key", "sim"])

    met = pivots.unionByName(others).repartition("p", "chunk").sortWithinPartitions("p", "chunk", F.col("key").asc_nulls_first())
    sims = written(met.select("p", "key", "text").mapInArrow(compare, "p binary, key binary, sim double"), "sims")
    discard(pairs, texts, dealt)
    return sims


def _linked(sims: DataFrame, similar: float, comp: DataFrame | None = None) -> DataFrame:
    """(node, comp) after the links among ``sims``; ``comp``: the components before."""
    links = sims.where(F.col("sim") >= similar).select(F.col("p").alias("a"), F.col("key").alias("b"))
    if comp is not None:
        links = links.unionByName(comp.select(F.col("node").alias("a"), F.col("comp").alias("b")))
    return written(components(links), "comp")


def _placed_rows(docs: DataFrame, similar: float) -> DataFrame:
    """A written table (doc_id, key, comp): a row for each row whose text isn't null, and its component's name."""
    spark = docs.sparkSession
    ship(spark)
    keyed = _keyed(docs)
    model = spark.sparkContext.broadcast(weights(keyed.select("text")))
    rows = written(_banded(keyed, model), "banded")
    in_bucket = rows.dropDuplicates(["key"]).select("key", "weight", F.explode("bands").alias("bucket"))
    shared = in_bucket.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    members = written(in_bucket.join(shared, "bucket"), "members")
    pivots = members.groupBy("bucket").agg(F.min_by(F.struct(F.col("key").alias("p"), F.col("weight").alias("p_weight")), F.struct(F.xxhash64("key"), "key")).alias("x"))
    pivots = written(pivots.select("bucket", "x.*"), "pivots")
    first = members.join(pivots, "bucket").where((F.col("key") != F.col("p")) & _alike(similar)).select("p", "key")
    sims = _verified(first, keyed, model)
    comp = _linked(sims, similar)
    here = _placed(members, comp)
    mixed = here.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("bucket")
    # every pair with its bucket's pivot is settled by now
    here = written(here.join(mixed, "bucket").join(pivots.select("bucket", F.col("p").alias("key")), ["bucket", "key"], "left_anti"), "mixed")
    if not here.isEmpty():
        bags = _bags(here, keyed, model)
        more = _verified(_between(here, bags, sims, similar), keyed, model)
        old, comp = comp, _linked(more, similar, comp)
        discard(bags, more, old)
    ids = rows.select("doc_id", "key")
    placed = written(ids.join(comp, ids["key"] == comp["node"], "left").select("doc_id", "key", F.coalesce("comp", "key").alias("comp")), "placed")
    discard(rows, members, pivots, sims, here, comp)
    model.destroy()
    return placed


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, class_id, class_size), one row for each row of ``docs`` (doc_id, text, any others).

    class_id is the least doc_id of the class.  Rows with a null text are classes of their
    own.  Equal texts are always in one class, empty ones too; texts of fewer than five
    words have one shingle.  Repeated rows and ids are rows of their text's class.
    """
    placed = _placed_rows(docs, similar)
    named = placed.groupBy("comp").agg(F.count("*").alias("n"), F.min("doc_id").alias("class_id"))
    alone = docs.where("text is null").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("class_size"))
    return join_hot(placed, written(named, "named"), ["comp"]).select("doc_id", "class_id", F.col("n").alias("class_size")).unionByName(alone)


def _bags(here: DataFrame, keyed: DataFrame, model) -> DataFrame:
    """(key, s, w, sketch): shingles and weights of the members; in one row of each key, without s, its sketch."""
    names = ["key", "s", "w", "sketch"]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            for key, x in zip(b.column("key"), shingles(b.column("text")), strict=True):
                s, v = w.bag(x)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()], pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.float64()), pa.array([sketch((s, v)).tolist()], pa.list_(pa.int64()))], names)
                if len(s):
                    yield pa.RecordBatch.from_arrays([pa.repeat(key, len(s)), pa.array(s.view(np.int64)), pa.array(v.astype(np.float64)), pa.nulls(len(s), pa.list_(pa.int64()))], names)

    texts = _texts(keyed, here.select("key").distinct())
    return written(texts.mapInArrow(spread, "key binary, s long, w double, sketch array<bigint>"), "shingles")


def _alike(similar: float):
    """Weights that allow the similarity."""
    return F.least("weight", "p_weight") >= similar * F.greatest("weight", "p_weight") * (1 - 1e-6)


def _placed(members: DataFrame, comp: DataFrame) -> DataFrame:
    """With each key's component so far."""
    return members.join(comp, members["key"] == comp["node"], "left").withColumn("comp", F.coalesce("comp", "key")).drop("node")


def _between(here: DataFrame, bags: DataFrame, compared: DataFrame, similar: float) -> DataFrame:
    """Pairs of members of different components that may be similar, by prefixes.

    Similar texts share at least ``similar`` of either's weight.  With every text's shingles
    in one order, rarest first, their first common one therefore has at most 1 - ``similar`` of
    the text's weight before it: only these prefixes are joined, and each pair meets at its
    first common shingle.  Pairs whose sketches say far less than ``similar`` are spared, as
    are those that two known similarities to one pivot rule out.
    """
    info = here.groupBy("key").agg(F.first("weight").alias("weight"), F.first("comp").alias("comp"))
    near = compared.groupBy("key").agg(F.min_by(F.struct("p", "sim"), "p").alias("x")).select("key", F.col("x.p").alias("via"), F.col("x.sim").alias("via_sim"))
    info = info.join(near, "key", "left").join(bags.where("s is null").select("key", "sketch"), "key")
    rows = bags.where("s is not null").select("key", "s", "w")
    often = rows.groupBy("s").agg(F.count("*").alias("n"))
    ordered = W.partitionBy("key").orderBy("n", "s").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(often, "s").withColumn("before", F.coalesce(F.sum("w").over(ordered), F.lit(0.0))).join(info, "key")
    prefix = written(rows.where((F.col("n") > 1) & (F.col("before") <= (1 - similar) * F.col("weight") * (1 + 1e-6))), "prefix")
    apart = prefix.groupBy("s").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("s")
    listed = prefix.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "s"))), lambda x: x["s"]).alias("list"))
    mine = prefix.join(apart, "s", "left_semi").join(listed, "key").drop("n", "w")
    other = mine.select([F.col(c).alias(f"p_{c}") for c in mine.columns])
    both, agreed = F.col("weight") + F.col("p_weight"), (1 + SKETCHED) / 2
    ruled = F.coalesce((F.col("via") == F.col("p_via")) & (F.abs(F.col("via_sim") - F.col("p_via_sim")) > 1 - similar + 1e-6), F.lit(False))
    shared = similar / (1 + similar) * both * (1 - 1e-6)
    fits = (F.col("weight") - F.col("before") >= shared) & (F.col("p_weight") - F.col("p_before") >= shared)
    differ = sum((F.bit_count(F.get("sketch", i).bitwiseXOR(F.get("p_sketch", i))) for i in range(1, SKETCH // 64)), F.bit_count(F.get("sketch", 0).bitwiseXOR(F.get("p_sketch", 0))))
    first = F.get(F.array_intersect("list", "p_list"), 0) == F.col("s")
    met = (F.col("s") == F.col("p_s")) & (F.col("comp") < F.col("p_comp")) & _alike(similar) & ~ruled & fits & (differ <= (1 - agreed) * SKETCH) & first
    return mine.join(other, met).select(F.col("p_key").alias("p"), "key").distinct()


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.withColumn("representative", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class stays: that with the least doc_id (null last), then the least MD5 of its text.

    Rows are told apart by id and text, so another text under the same id stays.  Rows with
    a null text are classes of their own and stay.
    """
    placed = _placed_rows(docs, SIMILAR)
    own = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = placed.groupBy("comp").agg(F.count("*").alias("n"), F.min(own).alias("best")).where("n > 1")
    met = join_hot(placed, written(best, "named"), ["comp"]).select("doc_id", "key", (own == F.col("best")).alias("stays"))
    met = written(met.groupBy("doc_id", "key", "stays").agg(F.count("*").alias("n")), "met")
    row = lambda key: F.unhex(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.hex(key)).cast("binary")))
    rows = docs.withColumn("_row", F.when(F.col("text").isNotNull(), row(F.unhex(F.md5(F.col("text").cast("binary"))))))
    kept = lacking(rows, met.where("not stays").select(row(F.col("key")).alias("_row")), "_row")
    again = met.where("stays and n > 1").select(row(F.col("key")).alias("_row"))
    if not again.isEmpty():
        kept = lacking(kept, again, "_row").unionByName(having(kept, again, "_row").dropDuplicates(["_row"]))
    discard(placed)
    return kept.select(docs.columns)
