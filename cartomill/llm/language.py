"""Language identification by error-correcting output codes.

Each language has a codeword; for each bit of it a logistic classifier over
hashed letter n-grams predicts which side a text is on.  Decoding picks the
codeword with the least sum of losses, each weighted by the bit's measured
reliability, and flags the text where the runner-up is close.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartomill.llm.chars import chunks, ngram_counts
from cartomill.llm.common import remainder, ship, table

DIMS = 4096
#: Training texts of each language, at most about so many.
PER_LANGUAGE = 600
AMBIGUOUS = 0.6
UNDETERMINED = "und"


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # languages x bits, of -1 and 1
    weights: np.ndarray  # dims + 1 x bits
    reliability: np.ndarray  # bits

    def decide(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and probability of the nearest codeword."""
        f = np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)
        loss = np.stack([(np.log1p(np.exp(-f * code)) * self.reliability).sum(1) for code in self.codes], 1)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        return p.argmax(1), p.max(1)


def codewords(n: int, bits: int = 31, seed: int = 7) -> np.ndarray:
    """All two-way splits of up to 5 languages; beyond that the random code of many that keeps codewords farthest apart."""
    if n == 1:
        return np.ones((1, 1))
    if n <= 5:
        return np.array([[1, *x] for x in itertools.product((1, -1), repeat=n - 1)][1:]).T
    rng, best, apart = np.random.default_rng(seed), None, -1
    bits = max(bits, 4 * int(np.ceil(np.log2(n))))
    for _ in range(300):
        code = rng.choice([-1, 1], (n, bits))
        if (abs(code.sum(0)) == n).any():
            continue
        near = ((code @ code.T) - 2 * bits * np.eye(n)).max()
        if best is None or -near > apart:
            best, apart = code, -near
    return best if best is not None else rng.choice([-1, 1], (n, bits))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    counts, letters = ngram_counts(texts, DIMS)
    x = np.sqrt(counts)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-9) * 8, letters


def fit(x: np.ndarray, langs: list[str], steps: int = 120, ridge: float = 1e-3) -> Model:
    """Logistic regression for each bit, by accelerated gradient descent; classes weigh alike."""
    names = sorted(set(langs))
    y = np.array([names.index(v) for v in langs])
    codes = codewords(len(names)).astype(np.float32)
    target = codes[y]
    share = (1 / np.bincount(y))[y]
    share = (share / share.sum()).astype(np.float32)[:, None]
    w = np.zeros((x.shape[1] + 1, codes.shape[1]), np.float32)
    ahead, rate = w.copy(), np.float32(4 / 65)
    for k in range(steps):
        f = x @ ahead[:-1] + ahead[-1]
        g = -target * share / (1 + np.exp(np.clip(target * f, -30, 30)))
        grad = np.concatenate([x.T @ g + np.float32(ridge) * ahead[:-1], g.sum(0, keepdims=True)])
        new = ahead - rate * grad
        w, ahead = new, new + np.float32(k / (k + 3)) * (new - w)
    right = (((x @ w[:-1] + w[-1]) * target > 0) * share).sum(0)
    return Model(names, codes, w, (np.clip(right, 0.5, 1) - 0.5) * 2 + 1e-3)


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model | None:
    """labelled: (doc_id, text, lang), none null.  A hash of the id picks about ``per_language`` texts of each language."""
    ship(labelled.sparkSession)
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if not counts:
        return None
    share: Column = F.lit(0.0)
    for lang, n in sorted(counts.items()):
        share = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(share)
    picked = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003)) < share * 1_000_003)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, langs = b.column("text").to_pylist(), b.column("lang").to_pylist()
            for lo, hi in chunks(texts):
                x, n = features(texts[lo:hi])
                rows = [(v.astype(np.float16).tobytes(), lang) for v, lang, k in zip(x, langs[lo:hi], n, strict=True) if k]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["x", "lang"])

    rows = picked.select("text", "lang").mapInArrow(counted, "x binary, lang string").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    return fit(np.stack([np.frombuffer(r["x"], np.float16) for r in rows]).astype(np.float32), [r["lang"] for r in rows])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """Adds lang_pred, score and ambiguous to ``docs``.

    Null texts and texts without a letter: ``und``, score 0, ambiguous; so is every text if
    nothing was learned.  The whole text counts, however long.
    """
    spark = docs.sparkSession
    ship(spark)
    held = spark.sparkContext.broadcast(model)
    keep = [c for c in docs.columns if c != text_col]

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            texts = [t or "" for t in b.column("_text").to_pylist()]
            lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            for lo, hi in chunks(texts) if m else ():
                x, n = features(texts[lo:hi])
                best, p = m.decide(x)
                some = n > 0
                lang[lo:hi] = np.where(some, np.array(m.languages, object)[best], UNDETERMINED)
                score[lo:hi] = np.where(some, p, 0)
            rest = [b.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang.tolist(), pa.string()), pa.array(score), pa.array(score < AMBIGUOUS)], [*keep, "lang_pred", "score", "ambiguous"])

    schema = docs.select(*keep, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous")).schema
    return docs.select(*keep, F.col(text_col).alias("_text")).mapInArrow(predict, schema)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    labelled = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), train(labelled))
