"""Group aggregates of panels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import is_missing
from .ranges import beside, quantiles


def unit_profile(units: DataFrame, entity: str, means: list[str], by: list[str]) -> DataFrame:
    """Units by key: mean of each column and number of distinct entities. Null keys are no group."""
    rows = units.dropna(subset=by)
    return rows.groupBy(*by).agg(F.count_distinct(entity).alias("n_entities"), *(F.avg(c).alias(c) for c in means))


def share_totals(profiles: DataFrame, by: list[str], weight: str, shares: list[str]) -> DataFrame:
    """Sums over units of weight and weight * share, and the shares of the whole."""
    totals = profiles.groupBy(*by).agg(F.count("*").alias("n_units"), F.sum(weight).alias(weight), *(F.sum(F.col(weight) * F.col(s)).alias(f"{s}_amount") for s in shares))
    return totals.withColumns({f"{s}_share": F.when(F.col(weight) > 0, F.col(f"{s}_amount") / F.col(weight)) for s in shares})


def frequency_histogram(rows: DataFrame, entity: str, label: str) -> DataFrame:
    """How many entities have so many rows and so many distinct labels."""
    per = rows.groupBy(entity).agg(F.count("*").alias("frequency"), F.count_distinct(label).alias("distinct_labels"))
    return per.groupBy("frequency", "distinct_labels").agg(F.count("*").alias("n_entities"))


def per_entity_min(rows: DataFrame, entity: str, cols: list[str]) -> DataFrame:
    return rows.groupBy(entity).agg(*(F.min(c).alias(c) for c in cols))


def missing_by_group(rows: DataFrame, group: str, col: str) -> DataFrame:
    """Rows, missing rows and rate by group, and the largest deviation of a group's rate from the pooled one."""
    miss = is_missing(F.col(col).cast("double")).cast("long")
    per = rows.groupBy(group).agg(F.count("*").alias("n"), F.sum(miss).alias("n_missing"))
    pooled = per.agg((F.sum("n_missing") / F.sum("n")).alias("pooled_rate"), F.max(F.lit(1)).alias("one")).drop("one")
    out = per.withColumn("rate", F.col("n_missing") / F.col("n")).crossJoin(F.broadcast(pooled))  # one row
    return out.withColumn("max_deviation", F.max(F.abs(F.col("rate") - F.col("pooled_rate"))).over(Window.partitionBy(F.lit(0))))


def spread(rows: DataFrame, by: list[str], value: str, within: list[str]) -> DataFrame:
    """Count, exact median and maximum by group, and the group's share of the rows of its ``within`` group."""
    per = rows.groupBy(*by).agg(F.count("*").alias("n"), F.max(value).alias("max"))
    per = beside(per, quantiles(rows, by, value, {"median": 0.5}), by)
    return per.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*within)))


def full_domain_counts(rows: DataFrame, col: str, domain: range) -> DataFrame:
    """Counts of every value of the domain, 0 where there is none."""
    values = rows.sparkSession.range(domain.start, domain.stop, domain.step).select(F.col("id").cast("int").alias(col))
    return values.join(rows.groupBy(F.col(col).cast("int").alias(col)).agg(F.count("*").alias("n")), col, "left").fillna({"n": 0})


def crosstab_percent(rows: DataFrame, by: Column, name: str, col: str, domain: list) -> DataFrame:
    """Percentages of each class within a row of the table; 0 where there is none."""
    table = rows.groupBy(by.alias(name)).pivot(col, domain).agg(F.count(F.lit(1))).fillna(0)
    total = sum((F.col(f"`{v}`") for v in domain), F.lit(0))
    return table.select(name, *((100.0 * F.col(f"`{v}`") / total).alias(f"pct_{v}") for v in domain))


def fold_summary(metrics: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Mean, sample and population deviation over folds."""
    fs = {"mean": F.avg, "sd": F.stddev_samp, "sd0": F.stddev_pop}
    return metrics.groupBy(*by).agg(F.count("*").alias("n_folds"), *(f(v).alias(f"{v}_{n}") for v in values for n, f in fs.items()))


def macro(metrics: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """Equal-weight means over groups where a metric is defined (not null), and how many those are."""
    return metrics.groupBy(*by).agg(F.count("*").alias("n_groups"), *(f(v).alias(n) for v in values for f, n in ((F.avg, f"macro_{v}"), (F.count, f"n_{v}"))))


def missing_ranking(rows: DataFrame, cols: list[str], percent: float) -> DataFrame:
    """Features by missing rate, ties in source order; ``selected``: the first ceil(percent % of them). One pass over the rows."""
    rates = rows.agg(*(F.avg(is_missing(F.col(c).cast("double")).cast("double")).alias(c) for c in cols))
    stacked = rates.select(F.posexplode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).alias("rate")) for c in cols))).alias("position", "f")).select("position", "f.*")
    ranked = stacked.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rate"), "position")))  # one row a feature
    return ranked.withColumn("selected", F.col("rank") <= F.ceil(F.lit(percent / 100 * len(cols))))


def group_missing_ranking(layers: list[tuple[DataFrame, list[str]]], group: str) -> DataFrame:
    """Groups by missing cells over all cells of several layers, most first, then by name."""
    parts = [df.select(group, sum((is_missing(F.col(c).cast("double")).cast("long") for c in cols), F.lit(0)).alias("missing"), F.lit(len(cols)).alias("cells")) for df, cols in layers]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    per = every.groupBy(group).agg(F.sum("missing").alias("missing"), F.sum("cells").alias("cells")).withColumn("rate", F.col("missing") / F.col("cells"))
    return per.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("rate"), group)))


def attribution_sums(values: DataFrame, by: str, features: list[str], groups: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Signed sums of attributions by class (long: class, feature, signed, size), and group sums' shares of a class's total."""
    sums = values.groupBy(by).agg(*(F.sum(c).alias(c) for c in features))
    long = sums.unpivot(by, features, "feature", "signed").withColumn("size", F.abs("signed"))
    names = F.create_map(*(F.lit(x) for kv in groups.items() for x in kv))
    grouped = long.groupBy(by, names[F.col("feature")].alias("feature_group")).agg(F.abs(F.sum("signed")).alias("size"))
    return long, grouped.withColumn("share", F.col("size") / F.sum("size").over(Window.partitionBy(by)))
