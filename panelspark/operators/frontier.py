"""Threshold frontiers, average precision and choice of policies.

Scores are counted by value first, so windows run over distinct scores, not rows; the running sums
over them are taken in two steps (within ranges that follow the scores' density, then over the ranges' totals), so no
single task orders all scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import finite
from .metrics import ratio
from .ranges import cut

def counts_by_score(df: DataFrame, by: list[str], score: str, target: str, n: str | None = None) -> DataFrame:
    """Positives and negatives of each distinct finite score. ``n``: how often a row counts."""
    rows, times = df.filter(finite(F.col(score))), F.col(n) if n else F.lit(1)
    count = lambda hit: F.sum(hit.cast("long") * times)
    return rows.groupBy(*by, score).agg(count(F.col(target) == 1).alias("pos"), count(F.col(target) != 1).alias("neg"))


def frontier(df: DataFrame, by: list[str], score: str, target: str, n: str | None = None) -> DataFrame:
    """One row for each distinct score as threshold (score >= threshold is positive), and one, ``nothing``, above all scores.

    Adds tp, fp, fn, tn, the positives ``gained`` at the score itself, precision, recall, F2 and false positives in 100 rows.
    """
    per = cut(counts_by_score(df, by, score, target, n), by, score)
    ranges = per.groupBy(*by, "__range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    above = Window.partitionBy(*by).orderBy(F.desc("__range")).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    ranges = ranges.select(*by, "__range", F.coalesce(F.sum("rp").over(above), zero).alias("ap"), F.coalesce(F.sum("rn").over(above), zero).alias("an"))
    inside = Window.partitionBy(*by, "__range").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    run = per.withColumns({"tp": F.sum("pos").over(inside), "fp": F.sum("neg").over(inside)}).join(ranges, [*by, "__range"])
    run = run.select(*by, F.col(score).alias("threshold"), F.lit(False).alias("nothing"), (F.col("tp") + F.col("ap")).alias("tp"), (F.col("fp") + F.col("an")).alias("fp"), F.col("pos").alias("gained"))
    totals = per.groupBy(*by).agg(F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"), F.max(score).alias("__max"))
    none = totals.select(*by, F.col("__max").alias("threshold"), F.lit(True).alias("nothing"), zero.alias("tp"), zero.alias("fp"), zero.alias("gained"))
    every = run.unionByName(none)
    every = every.join(F.broadcast(totals.drop("__max")) if not by else totals.drop("__max"), by) if by else every.crossJoin(F.broadcast(totals.drop("__max")))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("positives") - F.col("tp")
    return every.withColumns({
        "fn": fn, "tn": F.col("negatives") - fp, "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f2": ratio(5 * tp, 5 * tp + 4 * fn + fp),
        "false_per_100": ratio(100.0 * fp, F.col("positives") + F.col("negatives")),
    })


def average_precision(front: DataFrame, by: list[str]) -> DataFrame:
    """Step-wise area under precision and recall, tied scores together; null if only one class occurs."""
    rows = front.filter("NOT nothing")
    ap = F.when((F.max("positives") > 0) & (F.max("negatives") > 0), F.sum(F.col("gained") / F.col("positives") * F.col("precision")))
    return rows.groupBy(*by).agg(ap.alias("average_precision"))


def policy(front: DataFrame, by: list[str]) -> DataFrame:
    """The threshold with the best F2, then recall, precision, fewest false positives, fewest positives, highest threshold.

    ``outcome`` says so where nothing is gained by any threshold. Thresholds are pre-selected by an aggregate: only
    the best F2 of each group is ordered.
    """
    best = front.groupBy(*by).agg(F.max_by(F.struct("threshold", "nothing", "tp", "fp", "fn", "tn", "precision", "recall", "f2"), F.struct(
        F.coalesce("f2", F.lit(-1.0)), F.coalesce("recall", F.lit(-1.0)), F.coalesce("precision", F.lit(-1.0)), -F.col("fp"), -(F.col("tp") + F.col("fp")), "threshold", ~F.col("nothing"),
    )).alias("best"))
    return best.select(*by, "best.*", F.when(F.coalesce(F.col("best.tp"), F.lit(0)) > 0, "effective").otherwise("no_effective_threshold").alias("outcome"))


def ordered_policies(front: DataFrame, candidate: str, order: list[str]) -> DataFrame:
    """One row for each candidate of a ``frontier`` by ``candidate``: its own best threshold, and whether it is the ``primary`` choice of all.

    Thresholds are compared as in ``policy``; between candidates that are level so far, the earlier of ``order`` comes first, then the
    higher threshold. If no threshold of any candidate gains a positive, ``status`` is no_effective_rescue: every candidate stays at the row
    above all its scores, which changes nothing, and none is primary. Candidates outside ``order`` are left out; one of ``order`` without rows
    has none here. The choice over candidates takes a row for each; their thresholds are never gathered.
    """
    place = F.array_position(F.array(*map(F.lit, order)), F.col(candidate))
    known = front.filter(place > 0)
    worth = lambda *last: F.struct(F.coalesce("f2", F.lit(0.0)), F.coalesce("recall", F.lit(0.0)), F.coalesce("precision", F.lit(0.0)), -F.col("fp"), -(F.col("tp") + F.col("fp")), *last)
    row = F.struct("threshold", "nothing", "tp", "fp", "fn", "tn", "precision", "recall", "f2")
    own = known.groupBy(candidate).agg(F.max_by(row, worth("threshold", ~F.col("nothing"))).alias("best"), F.max_by(row, F.col("nothing")).alias("none"), F.max("tp").alias("__gain"))
    whole = own.agg(F.max("__gain").alias("__any"), F.max_by(candidate, F.struct(worth_of("best"), -place, F.col("best.threshold"))).alias("__first"))
    effective = F.coalesce(F.col("__any"), F.lit(0)) > 0
    chosen = own.crossJoin(F.broadcast(whole)).withColumn("p", F.when(effective, F.col("best")).otherwise(F.col("none")))  # one row
    return chosen.select(candidate, "p.*", F.when(effective, "selected").otherwise("no_effective_rescue").alias("status"), (effective & (F.col(candidate) == F.col("__first"))).alias("primary"))


def worth_of(policy: str) -> Column:
    """What policies of different candidates are compared by before their order."""
    at = lambda c: F.col(f"{policy}.{c}")
    return F.struct(F.coalesce(at("f2"), F.lit(0.0)), F.coalesce(at("recall"), F.lit(0.0)), F.coalesce(at("precision"), F.lit(0.0)), -at("fp"), -(at("tp") + at("fp")))


def stability(df: DataFrame, year: Column, score: str, target: str, threshold: float) -> DataFrame:
    """Counts at a threshold, pooled (null year) and by year."""
    hit = F.col(score) >= threshold
    y = F.col(target) == 1
    return df.withColumn("year", year).rollup("year").agg(F.count("*").alias("n"), F.sum((hit & y).cast("long")).alias("tp"), F.sum((hit & ~y).cast("long")).alias("fp"), F.sum((~hit & y).cast("long")).alias("fn"))
