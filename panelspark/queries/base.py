"""The panel that most queries work on, as a DataFrame and as SQL.

Entities are customers, months those of their orders, groups nations. The shares of five ordinal
classes are parts of the month's order value by size of the order line; coordinates are made from
the key. A prediction is the entity's previous month (persistence), rounded to two digits.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import cumulative_shares, majority_label, round_away, round_even
from ..sources import table

CUTOFF = "1999-01-01"


class Registry:
    """Collects queries and their SQL."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def __call__(self, sql: str | None = None, dates: tuple[str, ...] = ()):
        """``dates``: columns that both sides return as text."""

        def register(f):
            @functools.wraps(f)
            def run(spark: SparkSession, d: str) -> DataFrame:
                df = f(spark, d)
                return df.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in dates})

            self.queries[f.__name__] = run
            if sql:
                shown = ", ".join(f"strftime({c}, '%Y-%m-%d') AS {c}" for c in dates)
                self.sql[f.__name__] = f"SELECT * REPLACE ({shown}) FROM ({sql})" if dates else sql
            return f

        return register


def r6(df: DataFrame, *cols: str) -> DataFrame:
    """Doubles as the SQL rounds them."""
    return df.withColumns({c: round_away(F.col(c), 6) if df.schema[c].dataType.simpleString() == "double" else F.round(F.col(c), 6) for c in cols})


def panel(spark: SparkSession, d: str) -> DataFrame:
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    size = F.col("l_quantity")
    cls = F.when(size <= 22, 1).when(size <= 34, 2).when(size <= 42, 3).when(size <= 47, 4).otherwise(5)
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    rows = orders.select("o_orderkey", F.col("o_custkey").alias("entity"), F.trunc("o_orderdate", "month").alias("month"))
    rows = rows.join(lines.select("l_orderkey", cls.alias("cls"), cents.alias("cents")), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    sums = rows.groupBy("entity", "month").agg(F.sum("cents").alias("total"), *(F.sum(F.when(F.col("cls") == k, F.col("cents")).otherwise(0)).alias(f"t{k}") for k in range(1, 6)))
    shares = sums.select("entity", "month", "total", *((F.col(f"t{k}") / F.col("total")).alias(f"s{k}") for k in range(1, 6)))
    cum = cumulative_shares([F.col(f"s{k}") for k in range(1, 6)])
    return shares.withColumns({f"c{k}": c for k, c in cum.items()}).withColumns({
        "label": majority_label({k: F.col(f"c{k}") for k in cum}),
        "lat": (F.col("entity") * 37 % 1700) / 10 - 85, "lon": (F.col("entity") * 91 % 3600) / 10 - 180,
    })


def groups(spark: SparkSession, d: str) -> DataFrame:
    customers, nations = table(spark, d, "customer"), table(spark, d, "nation")
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("entity"), F.col("n_name").alias("grp"))


def predictions(spark: SparkSession, d: str) -> DataFrame:
    before = Window.partitionBy("entity").orderBy("month")
    lagged = panel(spark, d).withColumns({f"p{k}": round_even(F.lag(f"c{k}").over(before)) for k in range(2, 6)}).filter("p2 IS NOT NULL")
    return lagged.withColumns({"actual": F.col("label"), "predicted": majority_label({k: F.col(f"p{k}") for k in range(2, 6)}), "y": F.col("c3"), "p": F.col("p3")}).join(groups(spark, d), "entity")


_T = ", ".join(f"sum(CASE WHEN cls = {k} THEN cents ELSE 0 END) AS t{k}" for k in range(1, 6))
_S = ", ".join(f"CAST(t{k} AS DOUBLE) / CAST(total AS DOUBLE) AS s{k}" for k in range(1, 6))
_C = ", ".join(" + ".join(f"coalesce(s{j}, 0)" for j in range(k, 6)) + f" AS c{k}" for k in range(2, 6))


def label_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN {c}{k} >= 0.2::DOUBLE THEN {k}" for k in (5, 4, 3, 2)) + " ELSE 1 END"


PANEL = f"""lines AS (
  SELECT o_custkey AS entity, CAST(date_trunc('month', o_orderdate) AS DATE) AS month,
         CASE WHEN l_quantity <= 22 THEN 1 WHEN l_quantity <= 34 THEN 2 WHEN l_quantity <= 42 THEN 3 WHEN l_quantity <= 47 THEN 4 ELSE 5 END AS cls,
         CAST(round(l_extendedprice * 100) AS BIGINT) AS cents
  FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey),
sums AS (SELECT entity, month, sum(cents) AS total, {_T} FROM lines GROUP BY entity, month),
shares AS (SELECT entity, month, CAST(total AS BIGINT) AS total, {_S} FROM sums),
cums AS (SELECT *, {_C} FROM shares),
panel AS (
  SELECT *, {label_sql("c")} AS label, CAST(entity * 37 % 1700 AS DOUBLE) / 10 - 85 AS lat, CAST(entity * 91 % 3600 AS DOUBLE) / 10 - 180 AS lon
  FROM cums),
groups AS (SELECT c_custkey AS entity, n_name AS grp FROM customer JOIN nation ON c_nationkey = n_nationkey)"""
_L = ", ".join(f"round_even(lag(c{k}) OVER w * 100, 0) / 100 AS p{k}" for k in range(2, 6))
PREDICTIONS = PANEL + f""",
lagged AS (SELECT *, {_L} FROM panel WINDOW w AS (PARTITION BY entity ORDER BY month)),
predictions AS (
  SELECT *, label AS actual, {label_sql("p")} AS predicted, c3 AS y, p3 AS p
  FROM lagged JOIN groups USING (entity) WHERE p2 IS NOT NULL)"""
