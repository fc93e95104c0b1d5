"""Running sums and exact quantiles over values that no single task orders.

Values are counted first, so what follows works on distinct values. They are cut into ranges at approximate
quantiles, which a sketch of bounded size finds for each group, so ranges are about equally full wherever values
crowd. Sums over a group's ranges (at most PARTS of them) and sums inside a range are then two small steps.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of a group.
PARTS = 256


def beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``a`` with those columns of ``b``, which has each key once; null keys are keys. Without keys ``b`` is one row."""
    if not by:
        return a.crossJoin(F.broadcast(b))
    names = {c: f"__key{k}" for k, c in enumerate(by)}
    same = reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()))
    return a.join(b.withColumnsRenamed(names), same).drop(*names.values())


def cut(per: DataFrame, by: list[str], value: str, parts: int = PARTS) -> DataFrame:
    """Adds ``__range``, a number that grows with the value; ``per`` has one row for each value of a group."""
    edges = F.percentile_approx(value, [k / parts for k in range(1, parts)], 20 * parts)
    bounds = per.groupBy(*by).agg(edges.alias("__edges"))
    return beside(per, bounds, by).withColumn("__range", _less("__edges", value, parts)).drop("__edges")


def _less(edges: str, value: str, parts: int) -> Column:
    """How many of the ascending ``edges``, fewer than ``parts``, are less than the value: by halves, not one after another."""
    steps = F.array(*(F.lit(1 << k) for k in reversed(range((parts - 1).bit_length()))))
    found = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(edges, at + step - 1) < F.col(value), at + step).otherwise(at))
    return F.when(F.col(edges).isNotNull(), found)


def numbered(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds a number from 0 to each row, in the order of the key's hash; keys are distinct. No task orders all of them."""
    cut_up = cut(rows.withColumn("__h", F.xxhash64(key)), [], "__h")
    sizes = cut_up.groupBy("__range").agg(F.count("*").alias("__n"))  # PARTS rows at most
    sizes = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__range")) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy("__range").orderBy("__h", key)) - 1
    return cut_up.join(F.broadcast(sizes), "__range").withColumn(name, F.col("__before") + own).select(*rows.columns, name)


def ranked(rows: DataFrame, by: list[str], key: str, name: str) -> DataFrame:
    """Adds a number from 0 to each row of a group, in the order of a numeric key that is distinct there; rows without a key go."""
    per = cut(rows.filter(F.col(key).isNotNull()), by, key)
    in_group = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__range")  # PARTS rows at most
    sizes = per.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
    sizes = sizes.withColumn("__before", F.sum("__n").over(in_group) - F.col("__n")).drop("__n")
    own = F.row_number().over(Window.partitionBy(*by, "__range").orderBy(key)) - 1
    return beside(per.withColumn("__own", own), sizes, [*by, "__range"]).withColumn(name, F.col("__before") + F.col("__own")).select(*rows.columns, name)


def quantiles(rows: DataFrame, by: list[str], value: str, qs: dict[str, float]) -> DataFrame:
    """Exact quantiles with linear interpolation, by group; null and NaN are left out, and a group without values has nulls."""
    x = F.col(value).cast("double")
    per = rows.select(*by, x.alias("__x")).filter("__x IS NOT NULL AND NOT isnan(__x)").groupBy(*by, "__x").agg(F.count("*").alias("__n"))
    ranged = cut(per, by, "__x")
    in_group = Window.partitionBy(*(by or [F.lit(0)]))  # PARTS rows at most
    sums = ranged.groupBy(*by, "__range").agg(F.sum("__n").alias("__rn"))
    sums = sums.withColumns({"__before": F.sum("__rn").over(in_group.orderBy("__range")) - F.col("__rn"), "__total": F.sum("__rn").over(in_group)})
    asked = sums.select("*", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(float(q)).alias("q")) for n, q in qs.items()))).alias("__a"))
    place = (F.col("__total") - 1) * F.col("__a.q")
    holds = lambda at: (at >= F.col("__before")) & (at < F.col("__before") + F.col("__rn"))
    asked = asked.filter(holds(F.floor(place)) | holds(F.ceil(place))).select(*by, "__range", "__before", F.col("__a.name").alias("__name"), place.alias("__place"))
    few = beside(ranged, asked.groupBy(*by, "__range").agg(F.max("__before").alias("__before"), F.collect_list(F.struct("__name", "__place")).alias("__asked")), [*by, "__range"])
    inside = Window.partitionBy(*by, "__range").orderBy("__x")
    few = few.withColumn("__end", F.col("__before") + F.sum("__n").over(inside)).select(*by, "__x", "__n", "__end", F.inline("__asked"))
    at = lambda place: F.max(F.when((place >= F.col("__end") - F.col("__n")) & (place < F.col("__end")), F.col("__x")))
    ends = few.groupBy(*by, "__name", "__place").agg(at(F.floor("__place")).alias("low"), at(F.ceil("__place")).alias("high"))
    mixed = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise((F.ceil("__place") - F.col("__place")) * F.col("low") + (F.col("__place") - F.floor("__place")) * F.col("high"))
    named: list[Column] = [F.max(F.when(F.col("__name") == n, mixed)).alias(n) for n in qs]
    found = ends.groupBy(*by).agg(*named)
    if not by:
        return found
    names = {c: f"__key{k}" for k, c in enumerate(by)}
    same = reduce(lambda p, q: p & q, (F.col(c).eqNullSafe(F.col(k)) for c, k in names.items()))
    return rows.select(*by).distinct().join(found.withColumnsRenamed(names), same, "left").select(*by, *qs)
