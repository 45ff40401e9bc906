"""All operators and stages on nulls, empty and long texts, ties, repeated rows, empty tables and further columns."""

from __future__ import annotations

import pytest

from pyspark.sql import functions as F

from cartomill.llm import queries, sharding
from cartomill.llm.common import table
from corpus_pipeline import STAGES, run

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, copies int, key string, label string"
COPY = "one two three four five six seven eight nine ten"


def rows():
    def row(i, text, lang="en", source="s"):
        return (i, text, lang, source, 1, 2, 3, "k", "l")

    out = [row(1, None), row(2, ""), row(3, "   \n "), row(4, COPY), row(5, COPY), row(5, COPY), row(6, "a"), row(7, "7 %% 9"), row(8, "mot " * 30_000, "fr"), row(9, COPY, None, None)]
    out += [row(None, COPY), row(None, None), row(10, "der die das und nicht", "de", ""), row(11, "x" * 50_000), row(12, "😀 é ü token: abcdef123", "es", "t")]
    return out + [row(20 + i, f"plain words that say number {i} in a sentence of their own, and some more of them", "en", f"s{i % 3}") for i in range(12)]


def stored(spark, path, docs, labels, bench, vecs):
    spark.createDataFrame(docs, DOCS).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string, row string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    labels = [(i, i % 2, (i // 2) % 2) for i in range(20, 32)] + [(4, None, None), (None, 1, 1), (20, 1, 1)]
    vecs = [(0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, 1), (3, [0.0, 0.0], 1), (4, [float("nan"), 1.0], 1), (5, [None, 1.0], 1), (6, [3.0, 4.0], None), (7, [1.0, 2.0, 3.0], 1), (100, [5.0, 5.0], 1), (None, [1.0, 1.0], 1), (8, [], 1)]
    return stored(spark, tmp_path_factory.mktemp("odd"), rows(), labels, [(1, None, ""), (2, "", ""), (3, "a b", ""), (4, COPY, ""), (None, COPY, "")], vecs)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return stored(spark, tmp_path_factory.mktemp("empty"), [], [], [], [])


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd(spark, odd, name):
    got = queries.QUERIES[name](spark, odd).toPandas()
    if name not in ("op8_decontamination", "op10_nearest"):
        assert len(got) == len(rows())
    if name == "op1_near_duplicates":
        by = got[got.doc_id.notna()].groupby("doc_id").class_id.first()
        assert by[4] == by[5] == by[9] == 4 and by[1] == 1 and by[2] == 2 and by[6] == 6
    if name == "op3_language":
        assert set(got[got.doc_id.isin([1, 2, 3, 7])].lang_pred) == {"und"}
    if name == "op5_lm_scores":
        by = got[got.doc_id.notna()].groupby("doc_id").first()
        assert by.n_tokens[1] == by.n_tokens[2] == by.n_tokens[3] == 1 and by.n_tokens[8] == 30_001 and by.n_tokens[4] == 11
    if name == "op7_mixing":
        assert (got["taken"] <= 2 * got["size"]).all() and got["size"].max() == 30_000
    if name == "op8_decontamination":
        assert {4, 5, 9} <= set(got.doc_id.dropna()) and set(got.item_id) == {4}
    if name == "op9_kd_shards":
        assert got.shard.between(0, 23).all() and (got.groupby("shard").slot.max() + 1 == got.groupby("shard").size()).all()
    if name == "op10_nearest":
        assert got[(got.query_id == 0)].sort_values("rank").vec_id.tolist() == [1, 6, 100]
        assert set(got.query_id) == {0, 100}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty(spark, empty, name):
    assert queries.QUERIES[name](spark, empty).count() == 0


def test_stages(spark, odd, empty):
    for where, least in ((odd, 1), (empty, 0)):
        docs = table(spark, where, "documents")
        columns = docs.columns
        for name, stage in STAGES:
            docs = stage(spark, docs, where)
            if name != STAGES[-1][0]:
                assert docs.columns == columns
                docs = spark.createDataFrame(docs.toPandas().astype(object).where(lambda d: d.notna(), None), docs.schema) if docs.count() else docs
            assert docs.count() >= least


def test_run(spark, odd):
    assert {"doc_id", "shard", "slot"} <= set(run(spark, odd).columns)


CLASHES = "doc_id long, text string, lang string, source string, chars int, low int, high int, keep string, perplexity double, last int, most int, least int, dim int, cut int, node int, base int, spans int, row string, key string, n int, comp string, bucket int, copies int, size int, shard_ int"


def test_clashing_columns(spark, odd):
    """Columns that have the names of operators' own pass through the stages as they are."""
    mine = [(r[0], r[1], r[2], r[3], -7, 1, 2, "k", 0.5, 4, 5, 6, 7, 8, 9, 10, 11, "r", "y", 12, "c", 13, 14, 15, 16) for r in rows()]
    docs = spark.createDataFrame(mine, CLASHES)
    for name, stage in STAGES[:-1]:
        got = stage(spark, docs, odd)
        assert got.columns == docs.columns
        seen = got.drop("doc_id", "text", "lang", "source").distinct().collect()
        assert [tuple(r) for r in seen] == [mine[0][4:]], name
    placed = sharding.kd_shards(sharding.metadata(docs).withColumns({c: F.lit(5) for c in ("dim", "cut", "low", "high", "node", "base", "above", "shift", "n")}))
    assert placed.count() == len(mine) and placed.select("dim", "cut", "low", "node", "n").distinct().collect() == [(5, 5, 5, 5, 5)]
