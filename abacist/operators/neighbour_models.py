"""k-nearest-neighbour prediction."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from abacist.plans.neighbours import nearest_neighbours, points
from abacist.plans.skew import skew_join


@dataclass
class NearestNeighbours:
    """Training rows kept as a table; prediction is a neighbour search and a vote."""

    train: DataFrame = field(repr=False)
    key: str
    features: list[str]
    target: str
    k: int
    regression: bool

    def transform(self, df: DataFrame, key: str | None = None, broadcast_points: int | None = None) -> DataFrame:
        """Add `prediction`: majority of the k nearest (smallest label on ties), or their mean."""
        key = key or self.key
        options = {} if broadcast_points is None else {"broadcast_points": broadcast_points}
        known = self.train.filter(F.col(self.target).isNotNull())
        near = nearest_neighbours(points(df, key, self.features), points(known, self.key, self.features), self.k, **options)
        labels = known.select(F.col(self.key).alias("tid"), F.col(self.target).alias("_y"))
        voted = skew_join(near.select("tid", "qid"), labels, ["tid"])
        if self.regression:
            best = voted.groupBy("qid").agg(F.avg("_y").alias("prediction"))
        else:
            tally = voted.groupBy("qid", "_y").agg(F.count(F.lit(1)).alias("_n"))
            best = tally.groupBy("qid").agg(F.min(F.struct((-F.col("_n")).alias("neg"), F.col("_y").alias("y"))).alias("b"))
            best = best.select("qid", F.col("b")["y"].alias("prediction"))
        return df.join(best.withColumnRenamed("qid", "_qid"), F.col(key) == F.col("_qid"), "left").drop("_qid")


def knn(df: DataFrame, target: str, features: Sequence[str], key: str, k: int = 5, regression: bool = False) -> NearestNeighbours:
    return NearestNeighbours(df, key, list(features), target, k, regression)
