"""Rank-and-choose operators. Every order ends in a key, as Spark's sort isn't stable."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top(rows: DataFrame, by: list[str], order: list[Column], n: int = 1, name: str = "rank") -> DataFrame:
    """The first n rows of each group."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= n)


def running_number(rows: DataFrame, by: list[str], order: list[Column], name: str = "number") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def changed_entities(rows: DataFrame, entity: str, date: str, label: str) -> DataFrame:
    """Rows of entities whose two latest labels differ, or that have one row: the population of changes. Of equal dates the higher label is the later."""
    latest = top(rows, [entity], [F.desc(date), F.desc(label)], 2)
    chosen = latest.groupBy(entity).agg(F.count_distinct(label).alias("labels"), F.count("*").alias("n")).filter("labels > 1 OR n = 1")
    return rows.join(chosen.select(entity), entity, "left_semi")


def with_group_total(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    return rows.withColumn(name, F.sum(value).over(Window.partitionBy(*by)))


def ordered_by_category(rows: DataFrame, col: str, categories: list[str], then: list[Column]) -> DataFrame:
    return rows.orderBy(F.array_position(F.array(*map(F.lit, categories)), F.col(col)), *then)


def unpivoted(rows: DataFrame, ids: list[str], variants: dict[str, list[str]], names: list[str], variant: str = "model") -> DataFrame:
    """Wide to long: for each variant its columns under common names."""
    each = F.array(*(F.struct(F.lit(v).alias(variant), *(F.col(c).alias(n) for c, n in zip(cols, names, strict=True))) for v, cols in variants.items()))
    return rows.select(*ids, F.inline(each))


def widened(rows: DataFrame, ids: list[str], variant: str, values: list[str], of: str) -> DataFrame:
    """Long to wide: a column for each of the variants, its greatest value of a key. One aggregate with a row for each key, where a pivot first has one for each key and variant."""
    return rows.groupBy(*ids).agg(*(F.max(F.when(F.col(variant) == v, F.col(of))).alias(v) for v in values))


def stacked(blocks: list[DataFrame]) -> DataFrame:
    """Union of blocks whose columns may differ, in the order in which columns first appear."""
    out = blocks[0]
    for b in blocks[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def grid(spark, **axes: list) -> DataFrame:
    """Every combination of the axes' values. Its size is the product of their lengths."""
    out = spark.range(1).drop("id")
    for name, values in axes.items():
        out = out.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return out
