"""Paired cluster bootstrap. Clusters are drawn, never rows: a draw is a weighted sum of clusters' counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import numbered


#: Slots of a draw that one row unfolds to.
BLOCK = 10_000


def draws(spark: SparkSession, clusters: DataFrame, cluster: str, n: int, seed: int = 0) -> DataFrame:
    """(draw, cluster, times): as many clusters as there are, drawn with replacement, n times; from hashes, so the same in every run.

    Clusters are numbered in ranges of their hashes, and a draw is made in blocks of slots; the table has n rows for each
    cluster at most.
    """
    order = numbered(clusters.select(cluster).distinct(), cluster, "__k")
    size = order.count()
    blocks = max(1, -(-size // BLOCK))
    first = F.col("id") % blocks * BLOCK
    slots = spark.range(n * blocks if size else 0).select(F.floor(F.col("id") / blocks).alias("draw"), F.explode(F.sequence(first, F.least(first + BLOCK, F.lit(size)) - 1)).alias("__slot"))
    picked = slots.select("draw", F.pmod(F.xxhash64(F.lit(seed), "draw", "__slot"), F.lit(size)).alias("__k"))
    return picked.groupBy("draw", "__k").agg(F.count("*").alias("times")).join(order, "__k").drop("__k")


def intervals(counts: DataFrame, drawn: DataFrame, cluster: str, statistics: dict, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """For each statistic: draws in which it is defined, mean, and percentile bounds.

    ``counts`` has one row of sufficient counts for each cluster; ``statistics`` are expressions over sums of these
    (columns of the same names), null where undefined.
    """
    cols = [c for c in counts.columns if c != cluster]
    per = drawn.join(counts, cluster).groupBy("draw").agg(*(F.sum(F.col(c) * F.col("times")).alias(c) for c in cols))
    long = per.select(F.explode(F.array(*(F.struct(F.lit(n).alias("statistic"), e.cast("double").alias("value")) for n, e in statistics.items()))).alias("s")).select("s.*")
    return long.groupBy("statistic").agg(F.count("value").alias("n_draws"), F.avg("value").alias("mean"), F.percentile("value", F.lit(low)).alias("low"), F.percentile("value", F.lit(high)).alias("high"))
