"""Rows of the panel: shares, labels, rounding, splits and other row-level operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..operators import ranges, splits, windows
from ..sources import table
from .base import CUTOFF, PANEL, PREDICTIONS, Registry, label_sql, panel, predictions, r6

query = Registry()


@query(f"WITH {PANEL} SELECT entity, month, s1, s2, s3, s4, s5, c2, c3, c4, c5, label FROM panel", dates=("month",))
def panel_shares(spark, d):
    return panel(spark, d).drop("lat", "lon", "total")


@query(f"WITH {PANEL} SELECT label, count(*) AS n FROM panel GROUP BY label")
def label_rule_counts(spark, d):
    return panel(spark, d).groupBy("label").agg(F.count("*").alias("n"))


_HALF = "SELECT o_orderkey, s1, s2, s3, s4, CASE WHEN o_orderkey % 7 <> 0 THEN 0.1::DOUBLE END AS s5 FROM (SELECT o_orderkey, CAST(o_orderkey % 4 AS DOUBLE) / 10 AS s1, CASE WHEN o_orderkey % 5 <> 0 THEN 0.2::DOUBLE END AS s2, CAST(o_orderkey % 3 AS DOUBLE) / 10 AS s3, 0.15::DOUBLE AS s4 FROM orders)"


def _shares_with_gaps(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        "o_orderkey", ((k % 4) / 10).alias("s1"), F.when(k % 5 != 0, F.lit(0.2)).alias("s2"), ((k % 3) / 10).alias("s3"), F.lit(0.15).alias("s4"), F.when(k % 7 != 0, F.lit(0.1)).alias("s5")
    )


@query(f"WITH s AS ({_HALF}) SELECT o_orderkey, round(s2 + s3 + s4 + s5, 6) AS c2, round(s3 + s4 + s5, 6) AS c3, round(s4 + s5, 6) AS c4, round(s5, 6) AS c5 FROM s")
def cumulative_null_propagating(spark, d):
    cum = X.cumulative_shares([F.col(f"s{k}") for k in range(1, 6)], skip_null=False)
    return r6(_shares_with_gaps(spark, d).select("o_orderkey", *(c.alias(f"c{k}") for k, c in cum.items())), "c2", "c3", "c4", "c5")


@query(f"WITH s AS ({_HALF}) SELECT o_orderkey, round(coalesce(s2, 0) + s3 + s4 + coalesce(s5, 0), 6) AS c2, round(s3 + s4 + coalesce(s5, 0), 6) AS c3, round(s4 + coalesce(s5, 0), 6) AS c4, round(coalesce(s5, 0), 6) AS c5 FROM s")
def cumulative_skip_null(spark, d):
    cum = X.cumulative_shares([F.col(f"s{k}") for k in range(1, 6)])
    return r6(_shares_with_gaps(spark, d).select("o_orderkey", *(c.alias(f"c{k}") for k, c in cum.items())), "c2", "c3", "c4", "c5")


@query("SELECT rounded, count(*) AS n FROM (SELECT round_even(l_extendedprice / l_quantity / 7 * 100, 0) / 100 AS rounded FROM lineitem) GROUP BY rounded")
def round_half_even_2dp(spark, d):
    x = F.col("l_extendedprice") / F.col("l_quantity") / 7
    return table(spark, d, "lineitem").select(X.round_even(x).alias("rounded")).groupBy("rounded").agg(F.count("*").alias("n"))


@query(f"""WITH {PREDICTIONS}, wide AS (SELECT entity, month, p2, p3, p4, p5, p2 + p3 + p4 + p5 AS total FROM predictions)
SELECT entity, month, {label_sql("p")} AS label, total <= 0 AS nonpositive FROM wide""", dates=("month",))
def wide_labels_flagged(spark, d):
    """Keyed conversion of long class scores to wide labels; rows whose scores sum to nothing are flagged, not dropped."""
    rows = predictions(spark, d)
    long = windows.unpivoted(rows, ["entity", "month"], {str(k): [f"p{k}"] for k in range(2, 6)}, ["score"], "class")
    wide = windows.widened(long, ["entity", "month"], "class", ["2", "3", "4", "5"], "score")
    scores = {k: F.coalesce(F.col(f"`{k}`"), F.lit(0.0)) for k in range(2, 6)}
    return wide.select("entity", "month", X.majority_label(scores).alias("label"), (X.add(*scores.values()) <= 0).alias("nonpositive"))


@query(f"""WITH {PREDICTIONS} SELECT entity, month, {label_sql("p")} AS label FROM predictions
WHERE p2 + p3 + p4 + p5 > 0 AND c2 + c3 + c4 + c5 > 0""", dates=("month",))
def wide_labels_dropped(spark, d):
    """The older conversion: rows without positive scores on either side are dropped."""
    ps, cs = {k: F.col(f"p{k}") for k in range(2, 6)}, [F.col(f"c{k}") for k in range(2, 6)]
    return predictions(spark, d).filter((X.add(*ps.values()) > 0) & (X.add(*cs) > 0)).select("entity", "month", X.majority_label(ps).alias("label"))


@query(f"WITH {PANEL} SELECT CASE WHEN month < DATE '{CUTOFF}' THEN 'train' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT entity) AS n_entities FROM panel GROUP BY 1")
def temporal_split_counts(spark, d):
    return panel(spark, d).groupBy(splits.temporal(F.col("month"), CUTOFF).alias("split")).agg(F.count("*").alias("n"), F.count_distinct("entity").alias("n_entities"))


@query(f"WITH {PANEL} SELECT CASE WHEN month <= DATE '1997-12-01' THEN 'train' WHEN month >= DATE '1999-01-01' THEN 'test' ELSE 'calibration' END AS split, count(*) AS n FROM panel GROUP BY 1")
def three_way_split(spark, d):
    return panel(spark, d).groupBy(splits.three_way(F.col("month"), "1997-12-01", "1999-01-01").alias("split")).agg(F.count("*").alias("n"))


@query(f"WITH {PANEL} SELECT g.grp AS held, CASE WHEN groups.grp = g.grp THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM panel JOIN groups USING (entity), (SELECT DISTINCT grp FROM groups) g GROUP BY 1, 2")
def group_holdout(spark, d):
    from .base import groups

    g = groups(spark, d)
    folds = g.select(F.col("grp").alias("held")).distinct()
    rows = panel(spark, d).join(g, "entity").select("entity", "grp")
    return splits.expand_folds(rows, folds, splits.group_out(F.col("grp"), F.col("held"))).groupBy("held", "split").agg(F.count("*").alias("n"))


@query(f"""WITH {PANEL}, t AS (
  SELECT g.grp AS held, CASE WHEN groups.grp <> g.grp AND month < DATE '{CUTOFF}' THEN 'train' WHEN groups.grp = g.grp AND month >= DATE '{CUTOFF}' THEN 'test' ELSE 'excluded' END AS split
  FROM panel JOIN groups USING (entity), (SELECT DISTINCT grp FROM groups) g)
SELECT held, split, count(*) AS n FROM t WHERE split <> 'excluded' GROUP BY 1, 2""")
def strict_group_holdout(spark, d):
    from .base import groups

    g = groups(spark, d)
    rows = panel(spark, d).join(g, "entity").select("month", "grp")
    split = splits.strict_group_out(F.col("grp"), F.col("held"), F.col("month"), CUTOFF)
    return splits.expand_folds(rows, g.select(F.col("grp").alias("held")).distinct(), split).groupBy("held", "split").agg(F.count("*").alias("n"))


@query(f"""WITH {PANEL} SELECT CASE WHEN entity % 10 <> 3 AND month < DATE '{CUTOFF}' THEN 'train' WHEN entity % 10 = 3 AND month >= DATE '{CUTOFF}' THEN 'test' ELSE 'excluded' END AS split, count(*) AS n FROM panel GROUP BY 1""")
def strict_entity_holdout(spark, d):
    rows = panel(spark, d)
    held = rows.filter("entity % 10 = 3").select("entity").distinct()
    return splits.strict_entities_out(rows, held, "entity", "month", CUTOFF).groupBy("split").agg(F.count("*").alias("n"))


@query(f"""WITH {PANEL}, folds AS (SELECT CAST(y - 1996 AS INTEGER) AS fold, y FROM range(1996, 2000) t(y)),
t AS (SELECT fold, CASE WHEN year(month) BETWEEN 1996 AND y THEN 'train' WHEN year(month) = y + 1 THEN 'test' END AS split FROM panel, folds)
SELECT fold, split, count(*) AS n FROM t WHERE split IS NOT NULL GROUP BY 1, 2""")
def expanding_year_folds(spark, d):
    rows = splits.expand_folds(panel(spark, d).select("month"), splits.expanding_years(spark, 1996, 2000), splits.year_split(F.col("month")))
    return rows.groupBy("fold", "split").agg(F.count("*").alias("n"))


@query(f"WITH {PANEL} SELECT entity, month, label FROM panel WHERE year(month) = 1998", dates=("month",))
def year_filter(spark, d):
    return panel(spark, d).filter(F.year("month") == 1998).select("entity", "month", "label")


@query(f"WITH {PANEL} SELECT entity, month FROM panel WHERE s1 IS NOT NULL", dates=("month",))
def share_known_filter(spark, d):
    return panel(spark, d).filter(F.col("s1").isNotNull()).select("entity", "month")


@query("SELECT o_orderkey, CAST(l.n IS NULL AS TINYINT) AS value__missing, coalesce(CAST(l.n IS NULL AS INTEGER), 0) + CAST(o_totalprice IS NULL AS INTEGER) AS n_missing, CAST(NULL AS DOUBLE) AS hidden FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS n FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey")
def missing_indicators(spark, d):
    value = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("value"))
    rows = table(spark, d, "orders").join(value, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("hidden", F.col("value"))
    rows = X.suppress(X.missing_indicators(rows, ["value"]), ["hidden"])
    return rows.select("o_orderkey", "value__missing", X.missing_count(["value", "o_totalprice"]).alias("n_missing"), "hidden")


@query("SELECT p_partkey, round(p_retailprice * 1.1::DOUBLE, 6) AS p_retailprice, p_size FROM part")
def scaled_features(spark, d):
    return r6(X.scale_columns(table(spark, d, "part").select("p_partkey", "p_retailprice", "p_size"), "price$", 1.1), "p_retailprice")


@query(f"""WITH {PREDICTIONS} SELECT CASE WHEN actual > predicted THEN 'promotion' WHEN actual < predicted THEN 'demotion' ELSE 'unchanged' END AS change, count(*) AS n FROM predictions GROUP BY 1""")
def shift_labels(spark, d):
    return predictions(spark, d).groupBy(X.shift_label(F.col("predicted"), F.col("actual")).alias("change")).agg(F.count("*").alias("n"))


@query("SELECT l_orderkey % 100 AS k, count(*) AS n, count(*) FILTER (WHERE l_quantity + l_linenumber + l_tax >= 40) AS severe FROM lineitem GROUP BY 1")
def severe_rows(spark, d):
    rows = table(spark, d, "lineitem").withColumn("s", X.severe(["l_quantity", "l_linenumber", "l_tax"], 40))
    return rows.groupBy((F.col("l_orderkey") % 100).alias("k")).agg(F.count("*").alias("n"), F.count_if("s").alias("severe"))


@query(f"""WITH {PREDICTIONS} SELECT entity, month, round(p2 - 0.2, 6) AS margin_2, round(p3 - 0.2, 6) AS margin_3, round(p4 - 0.2, 6) AS margin_4, round(p5 - 0.2, 6) AS margin_5,
  round(p2 - p3, 6) AS drop_2_3, round(p3 - p4, 6) AS drop_3_4, round(p4 - p5, 6) AS drop_4_5 FROM predictions""", dates=("month",))
def score_margins(spark, d):
    m = X.margins({k: F.col(f"p{k}") for k in range(2, 6)})
    return r6(predictions(spark, d).select("entity", "month", *(c.alias(n) for n, c in m.items())), *m)


@query(f"""WITH {PREDICTIONS} SELECT predicted, CASE WHEN predicted = 3 AND p4 >= 0.15 THEN 4 ELSE predicted END AS promoted, count(*) AS n FROM predictions GROUP BY 1, 2""")
def gated_promotion(spark, d):
    return predictions(spark, d).groupBy("predicted", X.gated_promotion(F.col("predicted"), F.col("p4"), 0.15).alias("promoted")).agg(F.count("*").alias("n"))


@query(f"""WITH {PREDICTIONS}, t AS (SELECT CAST(actual >= 4 AS INTEGER) AS target FROM predictions WHERE actual >= 3),
n AS (SELECT sum(target) AS pos, count(*) - sum(target) AS neg FROM t)
SELECT target, round(CASE WHEN target = 1 THEN 1 ELSE 1 END, 6) AS w_none, round(CASE WHEN target = 1 THEN sqrt(neg / pos) ELSE 1 END, 6) AS w_root,
  round(CASE WHEN target = 1 THEN neg / pos ELSE 1 END, 6) AS w_full, count(*) AS n FROM t, n GROUP BY ALL""".replace("round(CASE WHEN target = 1 THEN 1 ELSE 1 END, 6)", "1.0::DOUBLE"))
def class_weights(spark, d):
    t = predictions(spark, d).filter("actual >= 3").select((F.col("actual") >= 4).cast("int").alias("target"))
    n = t.agg(F.sum("target").alias("pos"), (F.count("*") - F.sum("target")).alias("neg"))
    w = {f"w_{k}": X.balance_weight(F.col("target"), F.col("neg"), F.col("pos"), p) for k, p in (("none", 0.0), ("root", 0.5), ("full", 1.0))}
    return r6(t.crossJoin(F.broadcast(n)).groupBy("target", *(c.alias(k) for k, c in w.items())).agg(F.count("*").alias("n")), *w)


@query("SELECT CASE WHEN p_size <= 1 THEN 0 WHEN p_size <= 5 THEN 1 WHEN p_size <= 10 THEN 2 ELSE 3 END AS bucket, CASE WHEN abs(p_size - 25) / 100.0 < 0.1 THEN 'balanced' WHEN abs(p_size - 25) / 100.0 <= 0.2 THEN 'moderate' ELSE 'imbalanced' END AS balance, count(*) AS n FROM part GROUP BY 1, 2")
def value_buckets(spark, d):
    size = F.col("p_size")
    return table(spark, d, "part").groupBy(X.bucket(size).alias("bucket"), X.balance_class((size - 25) / 100).alias("balance")).agg(F.count("*").alias("n"))


@query(f"""WITH {PANEL}, k AS (SELECT entity, month, CASE entity % 3 WHEN 0 THEN 'static' WHEN 1 THEN 'lagged' ELSE 'current' END AS kind FROM panel)
SELECT entity, month, CASE kind WHEN 'lagged' THEN CAST(month - INTERVAL 12 MONTH AS DATE) WHEN 'current' THEN month END AS feature_month,
  CAST(CASE kind WHEN 'lagged' THEN 12 WHEN 'current' THEN 0 ELSE -1 END AS INTEGER) AS gap FROM k""", dates=("month", "feature_month"))
def feature_months(spark, d):
    k = F.col("entity") % 3
    rows = panel(spark, d).select("entity", "month", F.when(k == 0, "static").when(k == 1, "lagged").otherwise("current").alias("kind"))
    rows = rows.withColumn("feature_month", X.feature_month(F.col("month"), F.col("kind")))
    return rows.select("entity", "month", "feature_month", F.coalesce(X.month_gap(F.col("feature_month"), F.col("month")), F.lit(-1)).alias("gap"))


@query("SELECT p_partkey, replace(p_name, ' ', '_') AS p_name, replace(p_brand, ' ', '_') AS p_brand, replace(p_type, ' ', '_') AS p_type FROM part")
def replaced_strings(spark, d):
    return X.replace_in_strings(X.drop_matching(table(spark, d, "part"), ("p_size",), "price$"), " ", "_")


@query("SELECT o_orderkey, " + ", ".join(f"CAST(month(o_orderdate) = {m} AS INTEGER) AS month_{m}" for m in range(1, 13)) + " FROM orders")
def month_one_hot(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *(c.alias(n) for n, c in X.one_hot(F.month("o_orderdate"), range(1, 13), "month").items()))


@query(f"""WITH {PREDICTIONS} SELECT 'persistence' AS model, entity, month, class, CASE class WHEN 2 THEN p2 WHEN 3 THEN p3 WHEN 4 THEN p4 ELSE p5 END AS score FROM predictions, (SELECT CAST(c AS INTEGER) AS class FROM range(2, 6) t(c))
UNION ALL SELECT 'actual', entity, month, class, CASE class WHEN 2 THEN c2 WHEN 3 THEN c3 WHEN 4 THEN c4 ELSE c5 END FROM predictions, (SELECT CAST(c AS INTEGER) AS class FROM range(2, 6) t(c))""", dates=("month",))
def unpivot_long(spark, d):
    rows = predictions(spark, d)
    models = windows.unpivoted(rows, ["entity", "month"], {"persistence": [f"p{k}" for k in range(2, 6)], "actual": [f"c{k}" for k in range(2, 6)]}, ["2", "3", "4", "5"])
    return models.unpivot(["model", "entity", "month"], ["2", "3", "4", "5"], "class", "score").withColumn("class", F.col("class").cast("int"))


@query("SELECT 'nation' AS block, n_name AS name, n_nationkey::DOUBLE AS k, CAST(NULL AS DOUBLE) AS balance FROM nation UNION ALL SELECT 'supplier', s_name, NULL, s_acctbal FROM supplier")
def union_blocks(spark, d):
    a = table(spark, d, "nation").select(F.lit("nation").alias("block"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("k"))
    b = table(spark, d, "supplier").select(F.lit("supplier").alias("block"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return windows.stacked([a, b])


@query("""WITH q AS (SELECT quantile_cont(l_discount, [0.25, 0.5, 0.75]) AS v FROM lineitem)
SELECT CAST(x AS INTEGER) AS depth, rate, round(penalty, 6) AS penalty FROM range(1, 7) t(x), (SELECT unnest([0.05::DOUBLE, 0.1::DOUBLE]) AS rate), (SELECT DISTINCT unnest(v) AS penalty FROM q)""")
def param_grid(spark, d):
    """A grid one of whose axes are quartiles of a column."""
    found = ranges.quantiles(table(spark, d, "lineitem"), [], "l_discount", {"a": 0.25, "b": 0.5, "c": 0.75}).first()
    return r6(windows.grid(spark, depth=[1, 2, 3, 4, 5, 6], rate=[0.05, 0.1], penalty=sorted({found.a, found.b, found.c})), "penalty")


@query(f"WITH {PREDICTIONS} SELECT CAST(sum((p2 < 0 OR p2 > 1)::INT + (p3 < 0 OR p3 > 1)::INT + (p4 < 0 OR p4 > 1)::INT + (p5 < 0 OR p5 > 1)::INT) AS BIGINT) AS cells_outside, CAST(sum((p2 < p3 OR p3 < p4 OR p4 < p5)::INT) AS BIGINT) AS rows_not_monotone FROM (SELECT p2 * 1.01 - 0.002 AS p2, p3, p4 + 0.01 AS p4, p5 FROM predictions)")
def score_violations(spark, d):
    rows = predictions(spark, d).select((F.col("p2") * 1.01 - 0.002).alias("p2"), "p3", (F.col("p4") + 0.01).alias("p4"), "p5")
    return rows.agg(*(c.alias(n) for n, c in X.share_violations({k: F.col(f"p{k}") for k in range(2, 6)}).items()))


QUERIES, ORACLE_SQL = query.queries, query.sql
