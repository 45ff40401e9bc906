"""Colour clusters: one deterministic step of Lloyd's method, k-means over all rows, and k-means of each map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartomill.schemas import CLUSTERS


def assigned(points: DataFrame, centres: DataFrame, cols: list[str], key: str = "cluster") -> DataFrame:
    """Adds the nearest centre's key (ties to the lesser) and squared distance.  centres: k rows, broadcast."""
    held = F.broadcast(centres.agg(F.array_sort(F.collect_list(F.struct(key, *cols))).alias("_c")))
    d = lambda c: sum(((F.col(x) - c[x]) * (F.col(x) - c[x]) for x in cols[1:]), (F.col(cols[0]) - c[cols[0]]) * (F.col(cols[0]) - c[cols[0]]))
    best = F.array_min(F.transform("_c", lambda c: F.struct(d(c).alias("d"), c[key].alias("k"))))
    return points.join(held).withColumn("_b", best).withColumn(key, F.col("_b.k")).withColumn("dist2", F.col("_b.d")).drop("_b", "_c")


def lloyd(points: DataFrame, centres: DataFrame, cols: list[str], key: str = "cluster") -> DataFrame:
    """New centres: (key, cols, n)."""
    return assigned(points.drop(key), centres, cols, key).groupBy(key).agg(*[F.avg(c).alias(c) for c in cols], F.count("*").alias("n"))


def kmeans(points: DataFrame, cols: list[str], k: int = CLUSTERS, seed: int = 1) -> DataFrame:
    """Adds cluster; needs 20 rows for each cluster, else no row gets one."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    if points.limit(20 * k).count() < 20 * k:
        return points.withColumn("cluster", F.lit(None).cast("int"))
    vectors = VectorAssembler(inputCols=cols, outputCol="_f").transform(points)
    return KMeans(k=k, maxIter=20, tol=1.0, seed=seed, featuresCol="_f", predictionCol="cluster").fit(vectors).transform(vectors).drop("_f")


def fitted(x: np.ndarray, n: np.ndarray, k: int, attempts: int = 3, steps: int = 20, tol: float = 1.0, seed: int = 1) -> np.ndarray:
    """Cluster of each distinct point ``x`` (rows) that occurs ``n`` times: the best of some attempts from spread starts.

    Each attempt stops after ``steps``, or when no centre moves farther than ``tol``.
    """
    best: tuple[float, np.ndarray] | None = None
    for attempt in range(attempts):
        rng = np.random.default_rng([seed, attempt])
        centres = x[rng.choice(len(x), 1, p=n / n.sum())]
        while len(centres) < k:
            far = ((x[:, None] - centres[None]) ** 2).sum(2).min(1) * n
            centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum()) if far.sum() > 0 else 0]])
        for _ in range(steps):
            own = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            total = np.bincount(own, n, k)
            means = np.stack([np.bincount(own, n * c, k) for c in x.T], 1) / np.maximum(total, 1)[:, None]
            means = np.where(total[:, None] > 0, means, centres)
            moved, centres = np.sqrt(((means - centres) ** 2).sum(1)).max(), means
            if moved <= tol:
                break
        d = ((x[:, None] - centres[None]) ** 2).sum(2)
        if best is None or (d.min(1) * n).sum() < best[0]:
            best = (float((d.min(1) * n).sum()), d.argmin(1))
    return best[1]


def kmeans_by_map(points: DataFrame, cols: list[str], k: int = CLUSTERS) -> DataFrame:
    """Adds cluster, from a fit of each map alone; maps with under 20 rows for each cluster get null.

    Distinct values and their counts are fitted, so a task holds a map's palette, not its pixels.
    """
    schema = f"map_id string, {', '.join(f'{c} double' for c in cols)}, cluster int"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(cols)
        own = fitted(pdf[cols].to_numpy(float), pdf["n"].to_numpy(float), k) if pdf["n"].sum() >= 20 * k else None
        return pdf[["map_id", *cols]].assign(cluster=pd.Series([None] * len(pdf) if own is None else own, index=pdf.index, dtype="Int32"))

    palette = points.groupBy("map_id", *[F.col(c).cast("double").alias(c) for c in cols]).agg(F.count("*").alias("n"))
    found = palette.groupBy("map_id").applyInPandas(one, schema)
    return points.join(found, ["map_id", *cols], "left")
