"""Evaluation of ordinal and binary predictions; each metric is one aggregate, pooled or by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import CLASSES, SHARE_RULE, is_missing
from .ranges import quantiles

POSITIVE = 3


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b)


def _n(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def r2(y: Column, p: Column) -> Column:
    """1 - residual / total sum of squares; null with fewer than two rows or a constant truth."""
    total = F.var_pop(y) * F.count(y)
    return F.when((F.count(y) >= 2) & (F.max(y) > F.min(y)), 1 - F.sum(F.pow(y - p, F.lit(2.0))) / total)


def r2_reason(y: Column) -> Column:
    return F.when(F.count(y) < 2, "insufficient_observations").when(F.max(y) == F.min(y), "constant_actual_share")


def binary_parts(actual: Column, predicted: Column) -> dict[str, Column]:
    a, p = actual >= POSITIVE, predicted >= POSITIVE
    return {"tp": _n(a & p), "fp": _n(~a & p), "fn": _n(a & ~p), "tn": _n(~a & ~p)}


def binary(df: DataFrame, zero: bool = False) -> DataFrame:
    """Adds precision, recall, F1 and F2 to tp, fp, fn, tn; undefined: null with a reason (or 0)."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    out = {"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn), "f2": ratio(5 * tp, 5 * tp + 4 * fn + fp)}
    if zero:
        return df.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in out.items()})
    reasons = {"precision_reason": F.when(tp + fp == 0, "no_predicted_positive"), "recall_reason": F.when(tp + fn == 0, "no_actual_positive")}
    return df.withColumns({**out, **reasons})


def evaluate(df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted", y: str = "y", p: str = "p", zero: bool = False) -> DataFrame:
    """The whole set: n, accuracy, tp..tn, precision, recall, F1, F2, ordinal MAE, and R2 of shares, of flags, and of flags against shares."""
    a, b = F.col(actual), F.col(predicted)
    flag = lambda c: (c >= POSITIVE).cast("double")
    out = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.avg((a == b).cast("double")).alias("accuracy"), *(c.alias(k) for k, c in binary_parts(a, b).items()), F.avg(F.abs(a - b).cast("double")).alias("mae"),
        r2(F.col(y), F.col(p)).alias("r2_share"), r2_reason(F.col(y)).alias("r2_reason"), r2(flag(a), flag(b)).alias("r2_flags"), r2(flag(a), F.col(p)).alias("r2_flag_share"),
    )
    return binary(out, zero)


def confusion(df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted", domain: tuple[int, ...] = CLASSES) -> DataFrame:
    """Every cell of the grid with count, row total and row share (null for an empty row); labels outside the domain are left out."""
    counts = df.groupBy(*by, F.col(actual).cast("int").alias("actual"), F.col(predicted).cast("int").alias("predicted")).agg(F.count("*").alias("n"))
    axis = lambda n: F.explode(F.array(*map(F.lit, domain))).alias(n)
    groups = df.select(*by).distinct() if by else df.sparkSession.range(1).select()
    cells = groups.select("*", axis("actual")).select("*", axis("predicted"))
    full = cells.join(counts, [*by, "actual", "predicted"], "left").fillna({"n": 0})
    total = F.sum("n").over(Window.partitionBy(*by, "actual"))
    return full.withColumn("row_total", total).withColumn("row_share", ratio(F.col("n"), F.col("row_total")))


def class_metrics(cells: DataFrame, by: list[str]) -> DataFrame:
    """By class: support, predicted support, precision (and where nothing is predicted, null beside 0), recall, F1. From ``confusion``."""
    side = lambda cls, tp, support, called: F.struct(cls.alias("class"), tp.alias("tp"), support.alias("support"), called.alias("called"))
    zero, n, hit = F.lit(0).cast("long"), F.col("n"), F.col("actual") == F.col("predicted")
    sides = cells.select(*by, F.inline(F.array(side(F.col("actual"), F.when(hit, n).otherwise(zero), n, zero), side(F.col("predicted"), zero, zero, n))))
    per = sides.groupBy(*by, "class").agg(F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("called").alias("predicted_support"))
    tp, s, c = F.col("tp"), F.col("support"), F.col("predicted_support")
    filled = lambda x: F.coalesce(x, F.lit(0.0))
    return per.withColumns({"precision": ratio(tp, c), "precision_zero": filled(ratio(tp, c)), "recall": filled(ratio(tp, s)), "f1": filled(ratio(2 * tp, s + c))})


def class_summary(classes: DataFrame, by: list[str]) -> DataFrame:
    """Macro over classes with support, balanced accuracy (the same recalls), and macro F1 over all classes."""
    seen = F.col("support") > 0
    return classes.groupBy(*by).agg(
        F.avg(F.when(seen, F.col("precision_zero"))).alias("macro_precision"), F.avg(F.when(seen, F.col("recall"))).alias("macro_recall"), F.avg(F.when(seen, F.col("f1"))).alias("macro_f1"),
        F.avg(F.when(seen, F.col("recall"))).alias("balanced_accuracy"), F.avg("f1").alias("macro_f1_all"), F.sum(seen.cast("long")).alias("n_classes"),
    )


def distribution_gap(df: DataFrame, by: list[str], actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """Sum over classes of |share of actual - share of predicted|."""
    shares = [F.abs(F.avg((F.col(actual) == k).cast("double")) - F.avg((F.col(predicted) == k).cast("double"))) for k in CLASSES]
    return df.groupBy(*by).agg(sum(shares[1:], shares[0]).alias("distribution_gap"))


def line_fit(df: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """Slope and intercept of y on x; null unless x has two values."""
    two = F.max(x) > F.min(x)
    return df.groupBy(*by).agg(F.when(two, F.regr_slope(F.col(y), F.col(x))).alias("slope"), F.when(two, F.regr_intercept(F.col(y), F.col(x))).alias("intercept"))


def transitions(df: DataFrame, before: str, after: str) -> DataFrame:
    """Cells of the change from one prediction to another, with shares of the row and of all."""
    cells = confusion(df, [], before, after).withColumnsRenamed({"actual": "before", "predicted": "after"})
    return cells.withColumn("share_of_all", F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))))  # 25 cells


def change_counts(df: DataFrame, before: str, after: str) -> DataFrame:
    b, a = F.col(before), F.col(after)
    return df.agg(_n(a > b).alias("promotions"), _n(a < b).alias("demotions"), _n(a == b).alias("unchanged"), F.avg((a > b).cast("double")).alias("promoted_share"), F.avg((a < b).cast("double")).alias("demoted_share"))


def log_loss(target: str, score: str, eps: float = 1e-15, n: str | None = None) -> Column:
    """Mean log loss of a 0/1 target; null if only one class occurs. ``n``: how often a row counts."""
    y, p = F.col(target), F.least(F.greatest(F.col(score), F.lit(eps)), F.lit(1 - eps))
    gain = y * F.ln(p) + (1 - y) * F.ln(1 - p)
    return F.when(F.min(target) < F.max(target), -(F.sum(gain * F.col(n)) / F.sum(F.when(gain.isNotNull(), F.col(n))) if n else F.avg(gain)))


def tuning_score(metrics: DataFrame) -> DataFrame:
    """|accuracy + recall + precision + R2|."""
    return metrics.withColumn("tuning_score", F.abs(F.col("accuracy") + F.col("recall") + F.col("precision") + F.col("r2_share")))


def accuracy_from_rates(recall: Column, precision: Column, positives: Column, n: Column) -> Column:
    """Binary accuracy put together again from recall, precision and class counts (whole numbers)."""
    tp = F.rint(recall * positives)
    fp = F.when(precision > 0, F.rint(tp / precision - tp)).otherwise(0.0)
    return (tp + (n - positives - fp)) / n


def panel_summary(df: DataFrame, by: list[str], entity: str, x: str, y: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(entity).alias("n_entities"), *(f(c).alias(f"{n}_{c}") for c in (x, y) for n, f in (("min", F.min), ("max", F.max))))


def alert_table(df: DataFrame, entity: str, share: str, q: float = 0.7) -> DataFrame:
    """One row: entities, the exact q-quantile of their greatest share, and how many pass the fixed and the quantile threshold."""
    per = df.groupBy(entity).agg(F.max(share).alias("share")).filter(~is_missing(F.col("share")))
    cut = quantiles(per, [], "share", {"cutoff": q})
    return per.crossJoin(F.broadcast(cut)).groupBy("cutoff").agg(F.count("*").alias("entities"), _n(F.col("share") >= SHARE_RULE).alias("fixed_alerts"), _n(F.col("share") >= F.col("cutoff")).alias("quantile_alerts"))
