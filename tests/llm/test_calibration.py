"""Calibrated scores don't depend on how many rows of a class are picked."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cartomill.llm import toxicity, trees


def test_weighted_isotonic_undoes_thinning():
    rng = np.random.default_rng(0)
    s = rng.random(40_000)
    y = (rng.random(40_000) < 0.4 * s).astype(float)
    kept = (y == 1) | (rng.random(40_000) < 0.1)
    at = np.linspace(0.1, 0.9, 9)
    whole = np.interp(at, *trees.isotonic(s, y))
    thin = np.interp(at, *trees.isotonic(s[kept], y[kept], weight=np.where(y[kept] == 1, 1.0, (y == 0).sum() / (y[kept] == 0).sum())))
    assert np.abs(whole - thin).max() < 0.06 and np.abs(whole - 0.4 * at).max() < 0.06


def test_thinning_leaves_scores_alike(spark):
    """Three of ten texts with an insult are toxic, and two of a hundred others."""
    rng = np.random.default_rng(1)
    rude = rng.random(12_000) < 0.2
    toxic = rng.random(12_000) < np.where(rude, 0.3, 0.02)
    texts = [" ".join([*(f"w{k}" for k in rng.integers(0, 400, 12)), *["you idiot"] * int(r)]) for r in rude]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(t)) for i, t in enumerate(toxic)], "doc_id long, toxic int")
    for per_class in ((20_000, 20_000), (1_100, 3_000)):
        model = toxicity.train(docs, labels, per_class)
        got = toxicity.score(docs, model).groupBy(F.col("doc_id").isin([int(i) for i in np.flatnonzero(rude)]).alias("rude")).agg(F.avg("score").alias("p")).collect()
        p = {r.rude: r.p for r in got}
        assert abs(p[True] - 0.3) < 0.12 and p[False] < 0.06, (per_class, p)
