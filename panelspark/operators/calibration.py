"""Offsets on cumulative scores: a grid is scored in one pass and a candidate must pass gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..contracts import ContractError
from ..functions import isotonic_decreasing, majority_label, round_even

GRID_LIMIT = 10_000


def adjusted_label(scores: dict[int, str], d3, d4):
    """Label after adding one offset to classes 3 and up, another to 4 and up, and making the scores non-increasing."""
    ks = sorted(scores)
    moved = [F.col(scores[k]) + (F.when(F.lit(k >= 4), d4).when(F.lit(k == 3), d3).otherwise(F.lit(0.0))) for k in ks]
    return majority_label({k: round_even(c) for k, c in zip(ks, isotonic_decreasing(moved), strict=True)})


def offset_grid(rows: DataFrame, offsets: DataFrame, scores: dict[int, str], actual: str) -> DataFrame:
    """Metrics of each offset pair (d3, d4): mae, recall of class 4, balanced accuracy, precision and recall of class 3 up.

    ``offsets`` is a list of candidates, checked to have GRID_LIMIT rows at most, and broadcast. Rows are reduced
    to counts of (offset, actual, predicted) in the map tasks, at most 25 for each candidate.
    """
    if offsets.limit(GRID_LIMIT + 1).count() > GRID_LIMIT:
        raise ContractError("too many offsets")
    label = adjusted_label(scores, F.col("d3"), F.col("d4"))
    cells = rows.select(actual, *scores.values()).crossJoin(F.broadcast(offsets)).groupBy("d3", "d4", F.col(actual).alias("a"), label.alias("p")).agg(F.count("*").alias("n"))
    hit = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0))
    a, p = F.col("a"), F.col("p")
    recalls = [(hit((a == k) & (p == k)) / F.nullif(hit(a == k), F.lit(0))) for k in range(1, 6)]
    present = sum((F.when(r.isNotNull(), 1).otherwise(0) for r in recalls), F.lit(0))
    balanced = sum((F.coalesce(r, F.lit(0.0)) for r in recalls), F.lit(0.0)) / present
    tp, fp, fn = hit((a >= 3) & (p >= 3)), hit((a < 3) & (p >= 3)), hit((a >= 3) & (p < 3))
    return cells.groupBy("d3", "d4").agg(
        (F.sum(F.col("n") * F.abs(a - p)) / F.sum("n")).alias("mae"), recalls[3].alias("recall4"), balanced.alias("balanced"),
        (tp / F.nullif(tp + fp, F.lit(0))).alias("precision"), (tp / F.nullif(tp + fn, F.lit(0))).alias("recall"),
    )


def _order():
    c = F.col
    return [~c("ok"), c("mae"), -c("recall4"), -c("balanced"), F.abs("d3") + F.abs("d4"), c("d3"), c("d4")]


def _judged(grid: DataFrame, within: float) -> DataFrame:
    base = grid.filter("d3 = 0 AND d4 = 0").select(*(F.col(c).alias(f"b_{c}") for c in ("mae", "recall4", "balanced", "precision", "recall")))
    c = F.col
    good = (c("mae") < c("b_mae")) & (c("recall4") > c("b_recall4")) & (c("balanced") >= c("b_balanced")) & (c("precision") >= c("b_precision") - within) & (c("recall") >= c("b_recall") - within)
    return grid.crossJoin(F.broadcast(base)).withColumn("ok", F.coalesce(good, F.lit(False))).select(*grid.columns, "ok")


def ranked(grid: DataFrame, within: float = 0.02) -> DataFrame:
    """Every candidate with ``ok`` and ``rank``: acceptable ones first, then by mae, recall of class 4, balanced accuracy, size and value of the offsets.

    A grid has GRID_LIMIT rows at most, so one task orders it.
    """
    return _judged(grid, within).withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*_order())))


def accept(grid: DataFrame, within: float = 0.02) -> DataFrame:
    """The best acceptable offsets, or (0, 0): lower mae, higher recall of class 4, no worse balanced accuracy, precision and recall near those of (0, 0).

    Adds ``status``: accepted or identity. The grid must hold the pair (0, 0).
    """
    c = F.col
    some = _judged(grid, within).filter(c("ok") | ((c("d3") == 0) & (c("d4") == 0)))
    best = F.min_by(F.struct("d3", "d4", "mae", "recall4", "balanced", "precision", "recall", "ok"), F.struct(*(o.alias(f"o{k}") for k, o in enumerate(_order()))))
    return some.agg(best.alias("b")).select("b.*").withColumn("status", F.when(c("ok"), "accepted").otherwise("identity")).drop("ok")
