"""Hold-out designs, as a column ``split`` (train, calibration, test, excluded) or as fold tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import ContractError
from ..held import hold
from . import ranges

#: Entities that a seeded, sequential draw is made from: ranks of so many take 1.6 GB of one task. Rows that it hands on at once.
PERMUTED, CHUNK = 1 << 27, 65_536


def temporal(month: Column, cutoff: str) -> Column:
    """Before the cutoff: train; from it on: test."""
    return F.when(month < F.lit(cutoff).cast("date"), "train").when(month.isNotNull(), "test")


def three_way(month: Column, train_until: str, test_from: str) -> Column:
    """Bounds inclusive; between them: calibration."""
    if train_until >= test_from:
        raise ContractError("the calibration period is empty or negative")
    date = lambda d: F.lit(d).cast("date")
    return F.when(month <= date(train_until), "train").when(month >= date(test_from), "test").when(month.isNotNull(), "calibration")


def group_out(group: Column, held: Column) -> Column:
    return F.when(group == held, "test").otherwise("train")


def strict_group_out(group: Column, held: Column, month: Column, cutoff: str) -> Column:
    """Train on other groups before the cutoff, test on the held group after it; the rest is excluded."""
    before = month < F.lit(cutoff).cast("date")
    return F.when((group != held) & before, "train").when((group == held) & ~before, "test").otherwise("excluded")


def strict_entities_out(rows: DataFrame, held: DataFrame, entity: str, month: str, cutoff: str) -> DataFrame:
    """As ``strict_group_out``, with a table of held entities (unique)."""
    marked = rows.join(held.select(entity).withColumn("__held", F.lit(True)), entity, "left")
    return marked.withColumn("split", strict_group_out(F.coalesce("__held", F.lit(False)), F.lit(True), F.col(month), cutoff)).drop("__held")


def expand_folds(rows: DataFrame, folds: DataFrame, split: Column, limit: int = 10_000) -> DataFrame:
    """Every row for every fold, with its ``split`` there; excluded rows are dropped.

    ``folds`` is a list of designs, not data: it must have ``limit`` rows at most, and is broadcast.
    """
    if folds.limit(limit + 1).count() > limit:
        raise ContractError(f"more than {limit} folds")
    return rows.crossJoin(F.broadcast(folds)).withColumn("split", split).filter("split <> 'excluded'")


def expanding_years(spark: SparkSession, first: int, last: int) -> DataFrame:
    """Folds (fold, first_year, last_train_year, test_year): train on first..y, test on y + 1."""
    return spark.range(first, last).select((F.col("id") - first).cast("int").alias("fold"), F.lit(first).alias("first_year"), F.col("id").cast("int").alias("last_train_year"), (F.col("id") + 1).cast("int").alias("test_year"))


def year_split(month: Column) -> Column:
    """``split`` of a row for a fold of ``expanding_years``."""
    y = F.year(month)
    return F.when(y.between(F.col("first_year"), F.col("last_train_year")), "train").when(y == F.col("test_year"), "test").otherwise("excluded")


def _folds(n: int, k: int, seed: int) -> np.ndarray:
    order = np.arange(n)
    np.random.RandomState(seed).shuffle(order)
    fold = np.empty(n, "i4")
    for number, block in enumerate(np.array_split(order, k)):
        fold[block] = number
    return fold


def shuffled_folds(ids: list, k: int, seed: int = 0) -> list[int]:
    """Fold of each id (sorted order): a seeded shuffle cut into k contiguous blocks, the first ones one longer."""
    return _folds(len(ids), k, seed).tolist()


def _bounded(n: int) -> int:
    if n > PERMUTED:
        raise ContractError(f"a seeded draw from {n} entities: more than {PERMUTED}; hashed_folds and stratified_sample have no such bound")
    return n


def entity_folds(entities: DataFrame, entity: str, k: int, seed: int = 0) -> DataFrame:
    """A table (entity, fold): folds as a seeded shuffle of the sorted distinct ids gives them, cut into k blocks.

    Ids are numeric and are ranked by ranges, nulls left out. The generator is sequential, so one task shuffles ranks, not rows,
    12 bytes for each of PERMUTED at most; beyond, an error. Fewer ids than folds are an error too, but for no ids at all.
    """
    ids = hold(ranges.ranked(entities.select(entity).distinct(), [], entity, "__rank"))
    n = _bounded(ids.count())
    if 0 < n < k:
        raise ContractError(f"{n} entities for {k} folds")

    def shuffle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for one in frames:
            fold = _folds(n, k, seed) if len(one) else []
            for at in range(0, len(fold), CHUNK):
                part = fold[at : at + CHUNK]
                yield pd.DataFrame({"__rank": np.arange(at, at + len(part)), "fold": part})

    return ids.join(entities.sparkSession.range(0, 1, 1, 1).mapInPandas(shuffle, "__rank long, fold int"), "__rank").select(entity, "fold")


def seeded_sample(entities: DataFrame, entity: str, group: str, sizes: DataFrame, seed: int = 0) -> DataFrame:
    """``quota`` entities of each group, those that a seeded generator picks without replacement, group after group in their order.

    Ids are numeric and distinct within a group; groups of no quota draw nothing, null groups and ids are left out. One task draws
    ranks for a row a group, from PERMUTED entities of a group at most; the ids meet their ranks in a join.
    """
    ids = hold(ranges.ranked(entities.select(group, entity).dropna().distinct(), [group], entity, "__rank"))
    asked = ids.groupBy(group).agg(F.count("*").alias("__n")).join(sizes.select(group, F.col("quota").cast("long").alias("__quota")), group)
    if (odd := asked.filter("__quota > __n").first()) is not None:
        raise ContractError(f"{odd['__quota']} of {odd['__n']} entities of {odd[group]}")
    _bounded(asked.agg(F.max("__n")).first()[0] or 0)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(seed)
        for one in frames:
            for g, n, quota in zip(one[group], one["__n"], one["__quota"], strict=True):
                picked = rng.choice(int(n), size=int(quota), replace=False)
                for at in range(0, len(picked), CHUNK):
                    yield pd.DataFrame({group: g, "__rank": picked[at : at + CHUNK]})

    kind = entities.select(group).schema.add("__rank", "long")
    drawn = asked.filter("__quota > 0").repartition(1).sortWithinPartitions(group).mapInPandas(draw, kind)
    return ids.join(drawn, [group, "__rank"]).select(entity, group)


def hashed_folds(key: list[str], k: int, seed: int = 0) -> Column:
    """A fold from the key alone: no list of entities, no shuffle, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(k)).cast("int")


def quotas(sizes: DataFrame, group: str, n: str, sample: int) -> DataFrame:
    """Sample sizes by group (adds ``quota``): one each, the rest in proportion to n - 1, largest remainders first, ties by group.

    ``sizes`` has a row for each group; its totals are one row, so no group is gathered anywhere.
    """
    total = sizes.agg(F.sum(F.col(n) - 1).alias("__weight"), F.count("*").alias("__groups"))
    exact = F.when(F.col("__weight") > 0, (F.lit(sample) - F.col("__groups")) * (F.col(n) - 1) / F.col("__weight")).otherwise(F.lit(0.0))
    shared = sizes.crossJoin(F.broadcast(total)).withColumn("__exact", exact).withColumn("__floor", F.floor("__exact"))
    left = F.lit(sample) - F.col("__groups") - F.sum("__floor").over(Window.partitionBy(F.lit(0)))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc(F.col("__exact") - F.col("__floor")), group))  # one row a group
    shared = shared.withColumns({"__left": left, "__rank": rank})
    quota = F.least(F.col(n), 1 + F.col("__floor") + (F.col("__rank") <= F.col("__left")).cast("long"))
    return shared.withColumn("quota", quota.cast("long")).drop("__weight", "__groups", "__exact", "__floor", "__left", "__rank")


def stratified_sample(entities: DataFrame, entity: str, group: str, sizes: DataFrame, seed: int = 0) -> DataFrame:
    """``quota`` entities of each group, those with the least seeded hash."""
    order = Window.partitionBy(group).orderBy(F.xxhash64(F.lit(seed), entity), entity)
    return entities.join(sizes.select(group, "quota"), group).withColumn("__rank", F.row_number().over(order)).filter("__rank <= quota").drop("__rank", "quota")
