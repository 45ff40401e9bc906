"""Toxicity by gradient-boosted trees over dense features, with isotonic calibration.

Features: densities of hits in two lexicons (a short fixed one, and word stems
learned from labelled training rows), how near hits stand to the second
person, and rates of capitals, punctuation and obfuscation.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartomill.llm.chars import TABLE, points
from cartomill.llm.common import remainder, ship, table, written
from cartomill.llm.trees import Boosted, boost, isotonic

#: Labelled rows that are fitted on, at most about so many of each class.
PER_CLASS = (6000, 3000)
STEM = range(3, 8)
STEMS_KEPT = 3000
INSULTS = frozenset(
    """idiot moron stupid dumb loser scum trash worthless pathetic disgusting clown imbecile jerk fool garbage vermin filth
    idiota estupido estúpido basura imbecil imbécil asqueroso idiote stupide ordure débile crétin abruti dégoûtant
    dumm idiotisch trottel abschaum müll widerlich versager depp""".split()
)
YOU = frozenset("you your yours yourself u ur tu te toi vous votre vos ton ta tes du dich dir dein deine ihr euch sie tú ti usted ustedes vosotros su sus vos".split())
EDGES = ".,;:!?\"'()[]{}<>«»„“”‘’…¡¿*_~`|/\\-"
LEET = str.maketrans("013457@$!", "oieastasi")
NAMES = ("fixed", "learned", "learned_weight", "hits", "distinct", "near_you", "you", "capitals", "capital_words", "exclaimed", "punctuation", "symbols", "digits", "obfuscated", "stretched", "length")
STRETCHED = re.compile(r"(\w)\1{3,}")


def _classes() -> np.ndarray:
    """Of each code point: 0 other, 1 small letter, 2 capital, 3 digit, 4 white space, 5 punctuation, 6 symbol, 7 exclamation or question mark."""
    out = np.zeros(TABLE, np.int64)
    for i in range(TABLE):
        c = chr(i)
        out[i] = 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c.isspace() else 7 if c in "!?¡¿" else 5 if c in ".,;:\"'()-«»„“”‘’…" else 6 if c.isprintable() and not c.isalpha() else 0
    return out


CLASS = _classes()


class Words(dict):
    """Of each token: (its learned weight, fixed hit, obfuscated, second person); forgets all when full."""

    def __init__(self, stems: dict[str, float], full: int = 200_000) -> None:
        self.stems, self.heads, self.full = stems, {s[:3] for s in stems}, full

    def __missing__(self, token: str) -> tuple[float, int, int, int]:
        w = token.strip(EDGES).lower()
        plain = w.translate(LEET).replace("*", "").replace(".", "").replace("_", "").replace("-", "") if not w.isalpha() else w
        veiled = int(plain != w and any(c.isalpha() for c in w) and (plain in INSULTS or any(a.isalpha() and not b.isalnum() and c.isalpha() for a, b, c in zip(w, w[1:], w[2:]))))
        weight = 0.0
        if plain[:3] in self.heads:
            weight = max((self.stems.get(plain[:n], 0.0) for n in range(3, min(len(plain), STEM.stop - 1) + 1)), default=0.0)
        weight = max(weight, self.stems.get("=" + plain, 0.0))
        out = (weight, int(plain in INSULTS), veiled, int(w in YOU))
        if len(self) >= self.full:
            self.clear()
        self[token] = out
        return out


def features(text: str, words: Words) -> list[float]:
    """Of a whole text; all 0 for an empty one."""
    tokens = text.split()
    n = max(1, len(tokens))
    looked = [words[t] for t in tokens]
    hits = [i for i, x in enumerate(looked) if x[0] > 0 or x[1]]
    you = [i for i, x in enumerate(looked) if x[3]]
    near = 0
    if hits and you:
        at = np.searchsorted(you, hits)
        you_ = np.array([-(10**9), *you, 10**9])
        h = np.array(hits)
        near = int((np.minimum(h - you_[at], you_[at + 1] - h) <= 4).sum())
    kinds = np.bincount(CLASS[np.minimum(points(text), TABLE - 1)], minlength=8)
    chars = max(1, len(text))
    cased = max(1, kinds[1] + kinds[2])
    return [
        sum(x[1] for x in looked) / n, sum(x[0] > 0 for x in looked) / n, sum(x[0] for x in looked) / n,
        math.log1p(len(hits)), math.log1p(len({tokens[i] for i in hits})), near / n, len(you) / n,
        kinds[2] / cased, sum(t.isupper() and len(t) > 1 for t in tokens) / n, kinds[7] / n, kinds[5] / chars, kinds[6] / chars, kinds[3] / chars,
        sum(x[2] for x in looked) / n, len(STRETCHED.findall(text)) / n, math.log1p(len(tokens)),
    ]


@dataclass
class Model:
    stems: dict[str, float]
    trees: Boosted | None
    calibration: tuple[np.ndarray, np.ndarray] | None
    base: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(x), self.base)
        return np.clip(np.interp(self.trees.raw(x), *self.calibration), 0, 1)


def _stems(rows: DataFrame, totals: tuple[int, int]) -> dict[str, float]:
    """Word stems, and whole words behind a "=", with their log odds; counted in documents, over all of ``rows``."""
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist(), strict=True):
                found = set()
                for t in set(text.split()):
                    w = t.strip(EDGES).lower()
                    plain = w if w.isalpha() else w.translate(LEET).replace("*", "").replace(".", "").replace("_", "").replace("-", "")
                    if plain:
                        found.add("=" + plain)
                        found.update(plain[:k] for k in STEM if k <= len(plain))
                n[y].update(found)
        keys = list(n[0].keys() | n[1].keys())
        for i in range(0, len(keys), 50_000):
            part = keys[i : i + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array([n[0][k] for k in part]), pa.array([n[1][k] for k in part])], ["stem", "clean", "toxic"])

    least = max(2, totals[1] // 300)
    odds = F.log((F.col("toxic") + 0.2) / (totals[1] + 1.0)) - F.log((F.col("clean") + 0.5) / (totals[0] + 1.0))
    summed = rows.mapInArrow(counted, "stem string, clean long, toxic long").groupBy("stem").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    strong = summed.where(F.col("toxic") >= least).withColumn("odds", odds).where("odds > 2")
    best = strong.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "stem").limit(STEMS_KEPT)
    return {r["stem"]: r["odds"] for r in best.collect()}


def train(docs: DataFrame, labels: DataFrame, per_class: tuple[int, int] = PER_CLASS) -> Model:
    """docs: (doc_id, text); labels: (doc_id, toxic), one row for each id, both none null.

    Hashes of the id pick the rows and deal them to lexicon, trees and calibration.  Only
    the picked ids, as many as ``per_class`` allows, are broadcast; texts don't move.
    """
    ship(docs.sparkSession)
    n = {r["toxic"]: r["count"] for r in labels.groupBy("toxic").count().collect()}
    share = F.when(F.col("toxic") == 1, min(1.0, per_class[1] / max(1, n.get(1, 0)))).otherwise(min(1.0, per_class[0] / max(1, n.get(0, 0))))
    ids = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_003)) < share * 1_000_003).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(20)))
    picked = docs.where("text is not null").join(F.broadcast(ids), "doc_id")
    base = n.get(1, 0) / max(1, sum(n.values()))
    if len(n) < 2:
        return Model({}, None, None, base)
    first = picked.where("fold < 10")
    took = {r["toxic"]: r["count"] for r in first.groupBy("toxic").count().collect()}
    stems = _stems(first.select("text", "toxic"), (took.get(0, 0), took.get(1, 0)))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(stems)
        for b in batches:
            x = [np.array(features(t, words), np.float64).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(x, pa.binary()), b.column("toxic"), b.column("fold")], ["doc_id", "x", "toxic", "fold"])

    rows = picked.where("fold >= 10").select("doc_id", "text", "toxic", "fold").mapInArrow(measured, "doc_id long, x binary, toxic int, fold long").collect()
    rows.sort(key=lambda r: (r["doc_id"], bytes(r["x"])))
    if not rows:
        return Model({}, None, None, base)
    x = np.stack([np.frombuffer(r["x"], np.float64) for r in rows])
    y, fold = np.array([r["toxic"] for r in rows], float), np.array([r["fold"] for r in rows])
    grow = fold < 17
    if not 0 < y[grow].sum() < grow.sum():
        return Model(stems, None, None, base)
    trees = boost(x[grow], y[grow])
    late = ~grow if 20 <= y[~grow].sum() <= (~grow).sum() - 20 else np.ones(len(y), bool)
    # each class weighs in the calibration as it does among all labelled rows: rows of the rarer class were picked more often
    weight = np.where(y[late] == 1, n[1] / max(1, y[late].sum()), n[0] / max(1, (1 - y[late]).sum()))
    return Model(stems, trees, isotonic(trees.raw(x[late]), y[late], weight=weight), base)


def score(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """Adds score and predicted to ``docs``.  A null text is scored as an empty one; without labels of both kinds all get the base rate."""
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != text_col]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        words = Words(m.stems)
        for b in batches:
            x = np.array([features(t or "", words) for t in b.column("_text").to_pylist()]).reshape(-1, len(NAMES))
            p = m.scores(x)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(p), pa.array((p >= threshold).astype(np.int32))], [*keep, "score", "predicted"])

    schema = docs.select(*keep, F.lit(0.0).alias("score"), F.lit(0).alias("predicted")).schema
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(predict, schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 3) == 1
    labels = table(spark, sf_dir, "labels").where("toxic in (0, 1)").where(~held_out).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return score(docs.select("doc_id", held_out.alias("held_out"), "text"), train(docs, written(labels, "labels")))
