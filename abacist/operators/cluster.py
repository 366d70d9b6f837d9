"""Clustering and its quality measures."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.clustering import BisectingKMeans, GaussianMixture, KMeans, PowerIterationClustering
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from abacist.operators.hypothesis import one_row
from abacist.plans.neighbours import nearest_neighbours, points
from abacist.plans.quantiles import clean_double, complete_rows

VECTOR = "_vector"
MAX_CLUSTERS = 10_000


@dataclass
class Scaling:
    """Training means and population sds, kept for later rows."""

    columns: list[str]
    mean: list[float]
    sd: list[float]

    @classmethod
    def of(cls, df: DataFrame, columns: Sequence[str], standardize: bool) -> Scaling:
        if not standardize:
            return cls(list(columns), [0.0] * len(columns), [1.0] * len(columns))
        s = df.agg(*[F.struct(F.avg(clean_double(c)).alias("m"), F.stddev_pop(clean_double(c)).alias("s")).alias(f"c{i}") for i, c in enumerate(columns)]).first()
        return cls(list(columns), [x["m"] for x in s], [x["s"] or 1.0 for x in s])

    def scaled(self, df: DataFrame, keep: Sequence[str]) -> DataFrame:
        """Kept columns and scaled features; rows with a missing feature are dropped."""
        cols = [((clean_double(c) - F.lit(m)) / F.lit(s)).alias(f"_x{i}") for i, (c, m, s) in enumerate(zip(self.columns, self.mean, self.sd))]
        return complete_rows(df.select(*keep, *cols), self.names)

    @property
    def names(self) -> list[str]:
        return [f"_x{i}" for i in range(len(self.columns))]

    def vectors(self, df: DataFrame) -> DataFrame:
        return VectorAssembler(inputCols=self.names, outputCol=VECTOR).transform(self.scaled(df, df.columns))


@dataclass
class Clusters:
    """A fitted Spark clustering model with its scaling."""

    model: object
    scaling: Scaling
    source: DataFrame = field(repr=False)

    def transform(self, df: DataFrame) -> DataFrame:
        out = self.model.transform(self.scaling.vectors(df))
        extra = [F.col("probability")] if "probability" in out.columns else []
        return out.select(*df.columns, F.col("prediction").alias("cluster"), *extra)

    def centers(self, original_units: bool = True) -> DataFrame:
        """Cluster centres, long form."""
        if hasattr(self.model, "clusterCenters"):
            mids = self.model.clusterCenters()
        else:
            mids = [r["mean"].toArray() for r in self.model.gaussiansDF.collect()]
        rows = []
        for i, mid in enumerate(mids):
            for c, v, m, s in zip(self.scaling.columns, mid, self.scaling.mean, self.scaling.sd):
                rows.append((i, c, float(v * s + m if original_units else v)))
        return self.source.sparkSession.createDataFrame(rows, "cluster int, column string, value double")

    @property
    def inertia(self) -> float:
        return float(self.model.summary.trainingCost)


def kmeans(df: DataFrame, features: Sequence[str], k: int = 3, standardize: bool = True, seed: int = 42, max_iter: int = 100) -> Clusters:
    scaling = Scaling.of(df, features, standardize)
    data = scaling.vectors(df).select(VECTOR).persist()
    try:
        model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol=VECTOR, predictionCol="prediction").fit(data)
    finally:
        data.unpersist()
    return Clusters(model, scaling, df)


def gaussian_mixture(df: DataFrame, features: Sequence[str], k: int = 3, standardize: bool = True, seed: int = 42) -> Clusters:
    scaling = Scaling.of(df, features, standardize)
    data = scaling.vectors(df).select(VECTOR).persist()
    try:
        model = GaussianMixture(k=k, seed=seed, featuresCol=VECTOR).fit(data)
    finally:
        data.unpersist()
    return Clusters(model, scaling, df)


def hierarchical(df: DataFrame, features: Sequence[str], k: int = 3, standardize: bool = True, seed: int = 42) -> Clusters:
    """Top-down hierarchy by bisecting k-means."""
    scaling = Scaling.of(df, features, standardize)
    data = scaling.vectors(df).select(VECTOR).persist()
    try:
        model = BisectingKMeans(k=k, seed=seed, featuresCol=VECTOR).fit(data)
    finally:
        data.unpersist()
    return Clusters(model, scaling, df)


def spectral(df: DataFrame, features: Sequence[str], key: str, k: int = 3, neighbours: int = 10, standardize: bool = True, max_iter: int = 30) -> DataFrame:
    """Power iteration clustering on the nearest-neighbour graph: `(key, cluster)`."""
    scaling = Scaling.of(df, features, standardize)
    pts = points(scaling.scaled(df, [key]), key, scaling.names)
    near = nearest_neighbours(pts, pts, neighbours, exclude_self=True)
    # Each undirected edge once, similarity falling with distance.
    edges = near.select(
        F.least("qid", "tid").alias("src"), F.greatest("qid", "tid").alias("dst"), (F.lit(1.0) / (F.lit(1.0) + F.col("distance"))).alias("weight")
    ).groupBy("src", "dst").agg(F.max("weight").alias("weight"))
    pic = PowerIterationClustering(k=k, maxIter=max_iter, initMode="degree", srcCol="src", dstCol="dst", weightCol="weight")
    return pic.assignClusters(edges).select(F.col("id").alias(key), "cluster")


def cluster_metrics(labelled: DataFrame, features: Sequence[str], cluster: str = "cluster", silhouette: bool = True) -> DataFrame:
    """Calinski-Harabasz, Davies-Bouldin, inertia, and the squared-Euclidean silhouette."""
    clean = complete_rows(labelled.select(F.col(cluster).alias("c"), *[clean_double(f).alias(f"f{i}") for i, f in enumerate(features)]))
    data = clean.select("c", F.array(*[f"f{i}" for i in range(len(features))]).alias("x"))
    sizes = data.groupBy("c").agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLUSTERS + 1).collect()
    if len(sizes) > MAX_CLUSTERS:
        raise ValueError("too many clusters to score")
    sizes.sort(key=lambda r: r["c"])
    place = {r["c"]: i for i, r in enumerate(sizes)}
    n, mid, within = np.array([r["n"] for r in sizes], dtype=float), np.zeros((len(sizes), len(features))), 0.0
    long = data.select("c", F.posexplode("x").alias("i", "v")).groupBy("c", "i").agg(F.avg("v").alias("m"), F.var_pop("v").alias("s"))
    for r in long.collect():  # clusters x features
        mid[place[r["c"]], r["i"]] = r["m"]
        within += float(n[place[r["c"]]] * r["s"])
    total, k = n.sum(), len(sizes)
    grand = (n[:, None] * mid).sum(0) / total
    between = float((n * ((mid - grand) ** 2).sum(1)).sum())
    ch = (between / (k - 1)) / (within / (total - k)) if k > 1 and within > 0 and total > k else math.nan
    db = math.nan
    if k > 1:
        schema = StructType([StructField("_c", data.schema["c"].dataType), StructField("_m", ArrayType(DoubleType()))])
        centre = data.sparkSession.createDataFrame([(r["c"], [float(v) for v in m]) for r, m in zip(sizes, mid)], schema)
        # One row per cluster, at most MAX_CLUSTERS.
        joined = data.join(F.broadcast(centre), F.col("c") == F.col("_c"))
        square = F.aggregate(F.zip_with("x", "_m", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
        s = np.zeros(k)
        for r in joined.groupBy("c").agg(F.avg(F.sqrt(square)).alias("s")).collect():
            s[place[r["c"]]] = r["s"]
        apart = np.sqrt(((mid[:, None, :] - mid[None, :, :]) ** 2).sum(2))
        np.fill_diagonal(apart, np.inf)
        db = float(((s[:, None] + s[None, :]) / apart).max(1).mean())
    sil = math.nan
    if silhouette and 1 < k < total:
        vec = data.select(array_to_vector("x").alias("v"), F.col("c").cast("double").alias("p"))
        sil = float(ClusteringEvaluator(featuresCol="v", predictionCol="p").evaluate(vec))
    return one_row(labelled, {"n": int(total), "clusters": k, "inertia": within, "calinski_harabasz": ch, "davies_bouldin": db, "silhouette": sil})
