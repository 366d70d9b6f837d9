"""Splits and folds by key hash: independent of partitioning and row order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from abacist.plans.quantiles import exact_quantiles
from abacist.plans.skew import skew_join

BUCKETS = 1 << 16


def key_hash(key: str, seed: int) -> Column:
    return F.xxhash64(F.col(key), F.lit(seed))


def fold_column(key: str, folds: int, seed: int = 42) -> Column:
    return F.pmod(key_hash(key, seed), F.lit(folds)).cast("int")


def train_test_split(
    df: DataFrame, key: str, train_share: float = 0.8, seed: int = 42, stratify: str | None = None
) -> tuple[DataFrame, DataFrame]:
    """Exact shares, overall or per level of `stratify`, by smallest key hash.

    Hash buckets are counted first; only the one bucket per level in which the
    cut falls has to be ordered (about 1/65536 of that level's rows).
    """
    level = F.col(stratify) if stratify else F.lit(0)
    tagged = df.withColumns({"_level": level, "_hash": key_hash(key, seed)}).withColumn("_bucket", F.pmod("_hash", F.lit(BUCKETS)))
    counts = tagged.groupBy("_level", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    # At most 65536 rows per level.
    upto = F.sum("_n").over(Window.partitionBy("_level").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("_n").over(Window.partitionBy("_level"))
    want = F.round(F.lit(train_share) * F.col("_total")).cast("bigint")
    cuts = (
        counts.withColumns({"_upto": upto, "_total": total})
        .withColumn("_want", want)
        .filter((F.col("_upto") >= F.col("_want")) & (F.col("_upto") - F.col("_n") < F.col("_want")))
        .select(F.col("_level").alias("_cl"), F.col("_bucket").alias("_cut"), (F.col("_want") - F.col("_upto") + F.col("_n")).alias("_take"))
    )
    cuts = cuts.withColumnRenamed("_cl", "_level")
    joined = skew_join(tagged, cuts, ["_level"], "left", null_safe=True) if stratify else tagged.join(F.broadcast(cuts), "_level", "left")
    clear = joined.filter(F.col("_cut").isNull() | (F.col("_bucket") != F.col("_cut")))
    clear = clear.withColumn("_train", F.coalesce(F.col("_bucket") < F.col("_cut"), F.lit(False)))
    edge = joined.filter(F.col("_bucket") == F.col("_cut"))
    place = F.row_number().over(Window.partitionBy("_level").orderBy("_hash", key))
    edge = edge.withColumn("_train", place <= F.col("_take"))
    both = clear.unionByName(edge)
    return both.filter("_train").select(*df.columns), both.filter(~F.col("_train")).select(*df.columns)


def time_split(df: DataFrame, time: str, train_share: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Rows up to an exact quantile of the time column, and the rest."""
    is_number = df.schema[time].dataType.simpleString() in ("double", "float", "int", "bigint", "smallint", "tinyint")
    position = F.col(time).cast("double") if is_number else F.unix_micros(F.col(time).cast("timestamp")).cast("double")
    cut = exact_quantiles(df.select(position.alias("p")), ["p"], (train_share,))["p"][0]
    return df.filter(position <= F.lit(cut)), df.filter(position > F.lit(cut))


def three_way_split(
    df: DataFrame, key: str, train_share: float = 0.7, validation_share: float = 0.1, seed: int = 42, stratify: str | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Train, validation and test parts."""
    train, rest = train_test_split(df, key, train_share, seed, stratify)
    validation, test = train_test_split(rest, key, validation_share / (1 - train_share), seed + 1, stratify)
    return train, validation, test
