"""Checks that tables are what an operator takes them for. Each runs one aggregate job, or none."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table breaks what it was said to hold."""


def require_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    if missing := [c for c in cols if c not in df.columns]:
        raise ContractError(f"missing columns: {missing}")
    return df


def require_numeric(df: DataFrame, cols: list[str]) -> DataFrame:
    if bad := [c for c in cols if not isinstance(df.schema[c].dataType, T.NumericType)]:
        raise ContractError(f"not numeric: {bad}")
    return df


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(df: DataFrame, keys: list[str]) -> DataFrame:
    if (first := duplicates(df, keys).first()) is not None:
        raise ContractError(f"repeated key {first.asDict()}")
    return df


def require_all(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Every rule must be true (not null) in every row; all rules are counted in one pass."""
    names = list(rules)
    row = df.agg(*(F.sum((~F.coalesce(rules[n], F.lit(False))).cast("long")).alias(f"n{i}") for i, n in enumerate(names))).first()
    if bad := {n: row[i] for i, n in enumerate(names) if row[i]}:
        raise ContractError(f"rows that break a rule: {bad}")
    return df


def require_counts(df: DataFrame, rows: int | None = None, **distinct: int) -> DataFrame:
    """So many rows, and so many distinct values of each named column."""
    got = df.agg(F.count("*").alias("rows"), *(F.count_distinct(c).alias(c) for c in distinct)).first().asDict()
    want = {**({} if rows is None else {"rows": rows}), **distinct}
    if bad := {k: (got[k], v) for k, v in want.items() if got[k] != v}:
        raise ContractError(f"counts (found, wanted): {bad}")
    return df


def dependency_breaks(df: DataFrame, of: list[str], on: list[str]) -> DataFrame:
    """Keys ``on`` with more than one value of ``of``: no function from on to of. Nulls count as a value."""
    return df.groupBy(*on).agg(F.count_distinct(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in of))).alias("n_values")).filter("n_values > 1")


def key_differences(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that only one of the tables has, with the side."""
    left, right = a.select(*keys).distinct(), b.select(*keys).distinct()
    only = lambda x, y, side: x.exceptAll(y).withColumn("side", F.lit(side))
    return only(left, right, "left_only").unionByName(only(right, left, "right_only"))


def require_same_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> None:
    if (first := key_differences(a, b, keys).first()) is not None:
        raise ContractError(f"key in one table only: {first.asDict()}")


def require_same_rows(a: DataFrame, b: DataFrame) -> None:
    """The same rows, as often (two runs of one query, say)."""
    if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
        raise ContractError("the tables differ")


def table_digest(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row: number of rows and a digest that doesn't depend on their order.

    Rows are hashed over (null flag, text) of each column; the digests' leading 64 bits are added up in decimals,
    so that equal rows count as often as they occur.
    """
    cols = cols or df.columns
    parts = reduce(lambda a, b: a + b, ([F.col(c).isNull().cast("string"), F.coalesce(F.col(c).cast("string"), F.lit(""))] for c in cols))
    row = F.sha2(F.concat_ws("\x1f", *parts), 256)
    half = lambda at: F.sum(F.conv(F.substring(row, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return df.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(":", half(1), half(16)), 256).alias("digest"))


def missing_pattern_digest(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """``table_digest`` of the keys and of which values are missing."""
    from .functions import is_missing

    return table_digest(df.select(*keys, *(is_missing(F.col(c).cast("double")).alias(c) for c in cols)))
