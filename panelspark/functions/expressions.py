"""Row-level expressions over panel columns. All are pure Column functions, so Catalyst sees through them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CLASSES = (1, 2, 3, 4, 5)
SHARE_RULE = 0.20

__all__ = [
    "CLASSES", "SHARE_RULE", "add", "alert_flag", "balance_class", "balance_weight", "bucket", "cumulative_shares", "drop_matching", "feature_month", "finite",
    "gated_promotion", "is_missing", "isotonic_decreasing", "majority_label", "margins", "midnight_date", "missing_count", "missing_indicators", "month_gap", "names_with_prefix",
    "null_missing", "one_hot", "rename_checked", "replace_in_strings", "round_away", "round_even", "scale_columns", "severe", "share_violations", "shift_label", "strip_bom", "suppress", "strict_number",
]


def add(*cols: Column) -> Column:
    """Sum from left to right; null if any part is."""
    return reduce(lambda a, b: a + b, cols)


def cumulative_shares(shares: list[Column], skip_null: bool = True) -> dict[int, Column]:
    """Shares of class k and above, k from 2, added from class k upward (the order decides the last bit).

    ``skip_null`` counts a missing share as 0; without it any missing share makes the sum null.
    """
    part = (lambda c: F.coalesce(c, F.lit(0.0))) if skip_null else (lambda c: c)
    return {k: add(*(part(c) for c in shares[k - 1 :])) for k in range(2, len(shares) + 1)}


def majority_label(cumulative: dict[int, Column], least: float = SHARE_RULE) -> Column:
    """The highest class whose cumulative share reaches ``least``; 1 if none does. A null share never does."""
    out = F.lit(1)
    for k in sorted(cumulative):
        out = F.when(null_missing(cumulative[k]) >= least, F.lit(k)).otherwise(out)
    return out


def round_even(x: Column, digits: int = 2) -> Column:
    """Round the scaled value half to even, as NumPy does."""
    return F.rint(x * 10.0**digits) / 10.0**digits


def round_away(x: Column, digits: int = 2) -> Column:
    """Round the scaled value half away from zero, as SQL engines round doubles; Spark's ``round`` takes the shortest decimal instead, so ties fall otherwise."""
    scaled = F.abs(x) * 10.0**digits
    even = F.rint(scaled)
    out = F.signum(x) * F.when(scaled - even == 0.5, even + 1).otherwise(even) / 10.0**digits
    return F.when(even == F.lit(float("inf")), x).otherwise(out)


def is_missing(x: Column) -> Column:
    """Null, NaN or infinite."""
    return x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))


def finite(x: Column) -> Column:
    return ~is_missing(x)


def null_missing(x: Column) -> Column:
    """Null where a value is NaN; keeps comparisons with NaN from being true."""
    return F.when(~F.isnan(x), x)


def missing_indicators(df: DataFrame, cols: list[str], suffix: str = "__missing") -> DataFrame:
    return df.withColumns({c + suffix: is_missing(F.col(c).cast("double")).cast("byte") for c in cols})


def missing_count(cols: list[str]) -> Column:
    return add(*(is_missing(F.col(c).cast("double")).cast("int") for c in cols))


def suppress(df: DataFrame, cols: list[str]) -> DataFrame:
    """The columns stay, without values."""
    return df.withColumns({c: F.lit(None).cast(df.schema[c].dataType) for c in cols})


def scale_columns(df: DataFrame, pattern: str, factor: float) -> DataFrame:
    """Multiply every column whose name matches; zeros and nulls stay what they are."""
    return df.withColumns({c: F.col(c) * factor for c in df.columns if re.search(pattern, c)})


def shift_label(before: Column, after: Column) -> Column:
    return F.when(after > before, "promotion").when(after < before, "demotion").when(after == before, "unchanged")


def severe(cols: list[str], least: float = 10) -> Column:
    """Whether the sum of the columns reaches ``least``."""
    return add(*map(F.col, cols)) >= least


def alert_flag(share: Column, least: float = SHARE_RULE) -> Column:
    return F.coalesce(null_missing(share) >= least, F.lit(False))


def margins(cumulative: dict[int, Column], least: float = SHARE_RULE) -> dict[str, Column]:
    """How far each cumulative share is from the rule, and the drop from one class to the next."""
    ks = sorted(cumulative)
    out = {f"margin_{k}": cumulative[k] - least for k in ks}
    return out | {f"drop_{a}_{b}": cumulative[a] - cumulative[b] for a, b in zip(ks, ks[1:], strict=False)}


def gated_promotion(base: Column, score: Column, threshold: Column | float, gate: int = 3) -> Column:
    """``gate`` becomes ``gate + 1`` where a finite score reaches the threshold; nothing else changes."""
    return F.when((base == gate) & finite(score) & (score >= threshold), F.lit(gate + 1)).otherwise(base)


def balance_weight(target: Column, negatives: Column, positives: Column, power: float) -> Column:
    """Weight of a row: (negatives / positives) ** power for positives, else 1. Powers 0, 0.5 and 1 are none, root and full balance."""
    return F.when(target == 1, F.pow(negatives / positives, F.lit(power))).otherwise(F.lit(1.0))


def balance_class(smd: Column) -> Column:
    size = F.abs(smd)
    return F.when(size < 0.10, "balanced").when(size <= 0.20, "moderate").when(size > 0.20, "imbalanced")


def bucket(x: Column, edges: tuple[float, ...] = (1, 5, 10)) -> Column:
    """Number of the first edge that isn't below x; one past the last otherwise."""
    out = F.lit(len(edges))
    for k in range(len(edges) - 1, -1, -1):
        out = F.when(x <= edges[k], k).otherwise(out)
    return F.when(x.isNotNull(), out)


def month_gap(a: Column, b: Column) -> Column:
    """Calendar months from a to b."""
    return (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)


def feature_month(month: Column, kind: Column) -> Column:
    """The month whose value a feature may use: none if static, a year before if lagged, else the month itself."""
    return F.when(kind == "lagged", F.add_months(month, -12)).when(kind == "current", month)


def midnight_date(ts: Column) -> Column:
    """The date of a timestamp; fails where it isn't midnight."""
    return F.when(ts == F.date_trunc("day", ts), F.to_date(ts)).when(ts.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("a date has a time of day")).cast("date"))


def strict_number(text: Column, whole: bool = False) -> Column:
    """The number that a text says; fails where it says none, or isn't finite, or isn't whole though asked for."""
    x = text.try_cast("double")
    bad = x.isNull() & text.isNotNull() | is_missing(x) & x.isNotNull() | ((x != F.rint(x)) if whole else F.lit(False))
    return F.when(bad, F.raise_error(F.concat(F.lit("not a number as asked for: "), text)).cast("double")).otherwise(x)


def isotonic_decreasing(ys: list[Column]) -> list[Column]:
    """Least-squares non-increasing fit of a row's values, clipped to [0, 1].

    Value i is the least, over starts j <= i, of the greatest, over ends k >= i, of the mean of values j..k.
    """
    mean = lambda j, k: add(*ys[j : k + 1]) / float(k - j + 1)
    many = lambda f, xs: f(*xs) if len(xs) > 1 else xs[0]
    n, out = len(ys), []
    for i in range(n):
        fit = many(F.least, [many(F.greatest, [mean(j, k) for k in range(i, n)]) for j in range(i + 1)])
        out.append(F.least(F.greatest(fit, F.lit(0.0)), F.lit(1.0)))
    return out


def share_violations(cumulative: dict[int, Column]) -> dict[str, Column]:
    """Aggregates: cells outside [0, 1], and rows in which a higher class has the larger cumulative share."""
    ks = sorted(cumulative)
    cells = add(*(F.coalesce(((c < 0) | (c > 1)).cast("long"), F.lit(0)) for c in cumulative.values()))
    rows = reduce(lambda a, b: a | b, (F.coalesce(cumulative[a] < cumulative[b], F.lit(False)) for a, b in zip(ks, ks[1:], strict=False)))
    return {"cells_outside": F.sum(cells), "rows_not_monotone": F.sum(rows.cast("long"))}


def one_hot(x: Column, domain: range, prefix: str) -> dict[str, Column]:
    """An indicator for each value of a fixed domain."""
    return {f"{prefix}_{v}": F.coalesce((x == v).cast("int"), F.lit(0)) for v in domain}


def rename_checked(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns; fails if a source is missing or a target is taken."""
    left = set(df.columns) - set(names)
    if bad := set(names) - set(df.columns) | left & set(names.values()):
        raise ValueError(f"cannot rename: {sorted(bad)}")
    return df.withColumnsRenamed(names)


def drop_matching(df: DataFrame, names: tuple[str, ...] = (), pattern: str | None = None) -> DataFrame:
    return df.drop(*(c for c in df.columns if c in names or pattern and re.search(pattern, c)))


def names_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def replace_in_strings(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumns({f.name: F.replace(F.col(f.name), F.lit(old), F.lit(new)) for f in df.schema if isinstance(f.dataType, T.StringType)})


def strip_bom(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({c: c.lstrip("﻿") for c in df.columns if c.startswith("﻿")})
