"""Tables written with digests of key ranges, so that two of them are compared from the top down.

Rows are filed by a hash of their keys: FINE ranges, of which each COARSE one has FINE / COARSE. Files hold rows in this order. Beside the
rows stand the digests of fine ranges (a hash of each row, added up) and of coarse ones. Two tables differ at most where coarse digests
do; there fine digests are compared, and only rows of fine ranges that differ are read, as the scan skips other files and row groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..contracts import ContractError, require_unique

COARSE, FINE = 256, 1 << 16
#: Differing fine ranges up to which they are named in the scan's filter; beyond, most of the table differs.
NAMED = 4096


def _summed(rows: DataFrame, by: str) -> DataFrame:
    part = lambda at: F.sum(F.conv(F.substring("__row", at, 15), 16, 10).cast("decimal(38,0)"))
    return rows.groupBy(by).agg(F.count("*").alias("n"), part(1).alias("a"), part(16).alias("b"), part(31).alias("c"), part(46).alias("d"))


def write_digested(df: DataFrame, keys: list[str], folder: str) -> None:
    """Write ``df``, whose keys must be unique and not null, as rows/, fine/ and coarse/ in ``folder``. Columns named __range or __row aren't allowed."""
    if {"__range", "__row"} & set(df.columns):
        raise ContractError("a column is named __range or __row")
    if not df.filter(reduce(lambda x, y: x | y, (F.col(k).isNull() for k in keys))).isEmpty():
        raise ContractError("a key is null")
    require_unique(df, keys)
    text = lambda c: F.concat(F.col(c).isNull().cast("string"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    filed = df.withColumn("__range", F.pmod(F.xxhash64(*keys), F.lit(FINE)).cast("int"))
    filed.repartitionByRange("__range").sortWithinPartitions("__range").write.parquet(f"{folder}/rows")
    rows = df.sparkSession.read.parquet(f"{folder}/rows").withColumn("__row", F.sha2(F.concat_ws("\x1f", *map(text, sorted(df.columns))), 256))
    fine = _summed(rows, "__range")
    fine.repartitionByRange("__range").sortWithinPartitions("__range").write.parquet(f"{folder}/fine")
    fine = df.sparkSession.read.parquet(f"{folder}/fine")
    width = FINE // COARSE
    coarse = fine.groupBy((F.col("__range") / width).cast("int").alias("__range")).agg(*(F.sum(c).alias(c) for c in "nabcd"))
    coarse.coalesce(1).write.parquet(f"{folder}/coarse")  # COARSE rows


def _differing(a: DataFrame, b: DataFrame) -> list[int]:
    same = reduce(lambda x, y: x & y, (F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in "nabcd"))
    joined = a.alias("l").join(b.alias("r"), F.col("l.__range") == F.col("r.__range"), "full").filter(~same)
    return [r[0] for r in joined.select(F.coalesce("l.__range", "r.__range")).collect()]  # FINE at most


def differing_ranges(spark: SparkSession, left: str, right: str) -> list[int]:
    """Numbers of the fine ranges in which two written tables differ."""
    read = lambda folder, what: spark.read.parquet(f"{folder}/{what}")
    coarse, width = _differing(read(left, "coarse"), read(right, "coarse")), FINE // COARSE
    if not coarse:
        return []
    inside = reduce(lambda x, y: x | y, (F.col("__range").between(k * width, (k + 1) * width - 1) for k in coarse)) if len(coarse) < COARSE // 2 else F.lit(True)
    return sorted(_differing(read(left, "fine").filter(inside), read(right, "fine").filter(inside)))


def differences(spark: SparkSession, left: str, right: str, keys: list[str]) -> DataFrame:
    """(keys, status: only_left, only_right or changed, columns: those that changed) of rows in which two written tables differ."""
    ranges = differing_ranges(spark, left, right)
    rows = [spark.read.parquet(f"{folder}/rows") for folder in (left, right)]
    if sorted(rows[0].columns) != sorted(rows[1].columns):
        raise ContractError("the tables have different columns")
    if len(ranges) <= NAMED:
        rows = [r.filter(F.col("__range").isin(ranges)) for r in rows]
    a, b = (r.withColumn("__here", F.lit(True)).alias(n) for r, n in zip(rows, "lr", strict=True))
    on = reduce(lambda x, y: x & y, (F.col(f"l.{k}") == F.col(f"r.{k}") for k in keys))
    others = [c for c in rows[0].columns if c not in (*keys, "__range")]
    changed = F.array_compact(F.array(*(F.when(~F.col(f"l.`{c}`").eqNullSafe(F.col(f"r.`{c}`")), F.lit(c)) for c in others))) if others else F.array().cast("array<string>")
    both = a.join(b, on, "full")
    status = F.when(F.col("r.__here").isNull(), "only_left").when(F.col("l.__here").isNull(), "only_right").when(F.size(changed) > 0, "changed")
    shown = both.select(*(F.coalesce(f"l.{k}", f"r.{k}").alias(k) for k in keys), status.alias("status"), F.array_join(changed, ",").alias("columns"))
    return shown.filter("status IS NOT NULL").withColumn("columns", F.when(F.col("status") == "changed", F.col("columns")).otherwise(""))
