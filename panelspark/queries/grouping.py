"""Group aggregates, windows and top-k."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contracts import dependency_breaks, duplicates
from ..operators import aggregates, metrics, splits, windows
from ..sources import table
from .base import CUTOFF, PANEL, PREDICTIONS, Registry, groups, panel, predictions, r6

query = Registry()


@query(f"""WITH {PANEL}, u AS (SELECT grp, month, total, avg(c3) AS c3, count(DISTINCT entity) AS n_entities FROM panel JOIN groups USING (entity) WHERE total IS NOT NULL GROUP BY ALL)
SELECT grp, month, count(*) AS n_units, CAST(sum(total) AS BIGINT) AS total, round(sum(total * c3), 0) AS c3_amount, round(sum(total * c3) / sum(total), 6) AS c3_share FROM u GROUP BY grp, month""", dates=("month",))
def two_level_population(spark, d):
    rows = panel(spark, d).join(groups(spark, d), "entity").filter("total IS NOT NULL")
    units = aggregates.unit_profile(rows, "entity", ["c3"], ["grp", "month", "total"])
    out = aggregates.share_totals(units, ["grp", "month"], "total", ["c3"])
    return r6(out.withColumn("c3_amount", F.round("c3_amount", 0)), "c3_share")


@query(f"WITH {PANEL} SELECT frequency, distinct_labels, count(*) AS n_entities FROM (SELECT entity, count(*) AS frequency, count(DISTINCT label) AS distinct_labels FROM panel GROUP BY entity) GROUP BY 1, 2")
def frequency_histogram(spark, d):
    return aggregates.frequency_histogram(panel(spark, d), "entity", "label")


@query("SELECT l_suppkey, min(l_quantity) AS l_quantity, min(l_discount + 0) AS l_discount FROM lineitem GROUP BY 1")
def min_severity(spark, d):
    rows = table(spark, d, "lineitem").withColumn("l_discount", F.col("l_discount") + 0.0)
    return aggregates.per_entity_min(rows, "l_suppkey", ["l_quantity", "l_discount"])


@query("""WITH g AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE quality IS NULL) AS n_missing FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang),
p AS (SELECT *, n_missing / n AS rate, sum(n_missing) OVER () / sum(n) OVER () AS pooled_rate FROM g)
SELECT lang, n, n_missing, round(rate, 6) AS rate, round(pooled_rate, 6) AS pooled_rate, round(max(abs(rate - pooled_rate)) OVER (), 6) AS max_deviation FROM p""")
def missingness_by_group(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels"), "doc_id", "left")
    return r6(aggregates.missing_by_group(rows, "lang", "quality"), "rate", "pooled_rate", "max_deviation")


@query("""SELECT p_size % 5 AS task, p_brand, count(*) AS n, round(median(p_retailprice), 6) AS "median", max(p_retailprice) AS "max", round(count(*) / sum(count(*)) OVER (PARTITION BY p_size % 5), 6) AS share FROM part GROUP BY 1, 2""")
def group_spread(spark, d):
    rows = table(spark, d, "part").withColumn("task", F.col("p_size") % 5)
    return r6(aggregates.spread(rows, ["task", "p_brand"], "p_retailprice", ["task"]), "median", "share")


@query(f"WITH {PANEL}, c AS (SELECT label, count(*) AS n FROM panel WHERE label <> 4 GROUP BY label) SELECT CAST(k AS INTEGER) AS label, coalesce(n, 0) AS n FROM range(1, 6) t(k) LEFT JOIN c ON label = k")
def value_counts_full_domain(spark, d):
    return aggregates.full_domain_counts(panel(spark, d).filter("label <> 4"), "label", range(1, 6))


@query(f"WITH {PANEL} SELECT CAST(year(month) AS INTEGER) AS year, " + ", ".join(f"round(100.0 * count(*) FILTER (WHERE label = {k}) / count(*), 6) AS pct_{k}" for k in range(1, 6)) + " FROM panel GROUP BY 1")
def crosstab_year_pct(spark, d):
    out = aggregates.crosstab_percent(panel(spark, d), F.year("month"), "year", "label", [1, 2, 3, 4, 5])
    return r6(out, *(f"pct_{k}" for k in range(1, 6)))


@query(f"""WITH {PREDICTIONS}, m AS (SELECT entity % 5 AS fold, avg((actual = predicted)::INT) AS accuracy FROM predictions GROUP BY 1)
SELECT 'persistence' AS model, count(*) AS n_folds, round(avg(accuracy), 6) AS accuracy_mean, round(stddev_samp(accuracy), 6) AS accuracy_sd, round(stddev_pop(accuracy), 6) AS accuracy_sd0 FROM m""")
def fold_mean_sd(spark, d):
    m = predictions(spark, d).groupBy((F.col("entity") % 5).alias("fold")).agg(F.avg((F.col("actual") == F.col("predicted")).cast("double")).alias("accuracy"))
    return r6(aggregates.fold_summary(m.withColumn("model", F.lit("persistence")), ["model"], ["accuracy"]), "accuracy_mean", "accuracy_sd", "accuracy_sd0")


@query(f"""WITH {PREDICTIONS}, m AS (SELECT entity, count(*) FILTER (WHERE actual >= 3 AND predicted >= 3) / nullif(count(*) FILTER (WHERE predicted >= 3), 0) AS pr,
  count(*) FILTER (WHERE actual >= 3 AND predicted >= 3) / nullif(count(*) FILTER (WHERE actual >= 3), 0) AS re FROM predictions GROUP BY entity)
SELECT 'persistence' AS model, count(*) AS n_groups, round(avg(pr), 6) AS macro_precision, count(pr) AS n_precision, round(avg(re), 6) AS macro_recall, count(re) AS n_recall FROM m""")
def macro_defined(spark, d):
    m = metrics.evaluate(predictions(spark, d).withColumn("model", F.lit("persistence")), ["model", "entity"])
    return r6(aggregates.macro(m, ["model"], ["precision", "recall"]), "macro_precision", "macro_recall")


@query(f"""WITH {PANEL}, e AS (SELECT entity, max(c3) AS share FROM panel GROUP BY entity), q AS (SELECT quantile_cont(share, 0.7) AS cutoff FROM e)
SELECT round(cutoff, 6) AS cutoff, count(*) AS entities, count(*) FILTER (WHERE share >= 0.2) AS fixed_alerts, count(*) FILTER (WHERE share >= cutoff) AS quantile_alerts FROM e, q GROUP BY cutoff""")
def q70_alert_flags(spark, d):
    return r6(metrics.alert_table(panel(spark, d), "entity", "c3"), "cutoff")


@query("SELECT p_brand, round(quantile_cont(p_retailprice, 0.025), 6) AS low, round(quantile_cont(p_retailprice, 0.5), 6) AS mid, round(quantile_cont(p_retailprice, 0.975), 6) AS high FROM part GROUP BY 1")
def quantile_bounds(spark, d):
    return r6(aggregates.quantiles(table(spark, d, "part"), ["p_brand"], "p_retailprice", {"low": 0.025, "mid": 0.5, "high": 0.975}), "low", "mid", "high")


@query(f"""WITH {PANEL}, s AS (SELECT grp, count(*) AS n FROM groups GROUP BY grp), t AS (SELECT *, (100 - count(*) OVER ()) * (n - 1) / sum(n - 1) OVER () AS exact, count(*) OVER () AS g FROM s),
u AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, grp) AS rank, 100 - g - sum(floor(exact)) OVER () AS rest FROM t)
SELECT grp, n, CAST(least(n, 1 + floor(exact) + CASE WHEN rank <= rest THEN 1 ELSE 0 END) AS BIGINT) AS quota FROM u""")
def hamilton_quotas(spark, d):
    return splits.quotas(groups(spark, d).groupBy("grp").agg(F.count("*").alias("n")), "grp", "n", 100)


@query("SELECT grp, n FROM (SELECT n_name AS grp, least(count(*), 3) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)")
def stratified_sample_sizes(spark, d):
    """So many entities are drawn from each group as were asked for."""
    g = groups(spark, d)
    sizes = g.groupBy("grp").agg(F.least(F.count("*"), F.lit(3)).alias("quota"))
    return splits.stratified_sample(g, "entity", "grp", sizes).groupBy("grp").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT count(DISTINCT o_custkey) AS n FROM orders), f AS (SELECT CAST(unnest(range(5)) AS INT) AS fold)
SELECT fold, n // 5 + CASE WHEN fold < n % 5 THEN 1 ELSE 0 END AS n_entities, CAST(1 AS BIGINT) AS folds_of_an_entity FROM f, n""")
def entity_folds(spark, d):
    """Five folds of the customers with orders: blocks of a seeded shuffle, and each customer in one."""
    folds = splits.entity_folds(table(spark, d, "orders"), "o_custkey", 5)
    of_one = folds.groupBy("o_custkey").agg(F.count("*").alias("k"), F.first("fold").alias("fold"))
    return of_one.groupBy("fold").agg(F.count("*").alias("n_entities"), F.max("k").alias("folds_of_an_entity"))


@query(f"""WITH {PANEL}, s AS (SELECT grp, count(*) AS n FROM groups GROUP BY grp), t AS (SELECT *, (100 - count(*) OVER ()) * (n - 1) / sum(n - 1) OVER () AS exact, count(*) OVER () AS g FROM s),
u AS (SELECT *, row_number() OVER (ORDER BY exact - floor(exact) DESC, grp) AS rank, 100 - g - sum(floor(exact)) OVER () AS rest FROM t)
SELECT grp, CAST(least(n, 1 + floor(exact) + CASE WHEN rank <= rest THEN 1 ELSE 0 END) AS BIGINT) AS n_drawn, CAST(0 AS BIGINT) AS n_of_other_groups FROM u""")
def seeded_sample(spark, d):
    """A hundred entities, drawn by a seeded generator in the groups' quotas: as many as asked for, each of its own group."""
    g = groups(spark, d)
    drawn = splits.seeded_sample(g, "entity", "grp", splits.quotas(g.groupBy("grp").agg(F.count("*").alias("n")), "grp", "n", 100))
    own = drawn.join(g.select("entity", F.col("grp").alias("own")), "entity")
    return own.groupBy("grp").agg(F.countDistinct("entity").alias("n_drawn"), F.count_if(F.col("own") != F.col("grp")).alias("n_of_other_groups"))


_GAPS = "SELECT o_orderkey, o_orderstatus, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_totalprice END AS f1, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_totalprice END AS f2, o_totalprice AS f3, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE 1.0 END AS f4 FROM orders"


def _gaps(spark, d):
    o, k = table(spark, d, "orders"), F.col("o_orderkey")
    return o.select("o_orderkey", "o_orderstatus", F.when(k % 3 != 0, F.col("o_totalprice")).alias("f1"), F.when(k % 5 != 0, F.col("o_totalprice")).alias("f2"), F.col("o_totalprice").alias("f3"), F.when(F.col("o_custkey") % 3 != 0, 1.0).alias("f4"))


@query(f"""WITH g AS ({_GAPS}), r AS (SELECT unnest([{{'feature': 'f1', 'position': 0, 'rate': avg((f1 IS NULL)::INT)}}, {{'feature': 'f2', 'position': 1, 'rate': avg((f2 IS NULL)::INT)}}, {{'feature': 'f3', 'position': 2, 'rate': avg((f3 IS NULL)::INT)}}, {{'feature': 'f4', 'position': 3, 'rate': avg((f4 IS NULL)::INT)}}]) AS x FROM g),
f AS (SELECT x.feature AS feature, x.position AS position, x.rate AS rate FROM r)
SELECT position, feature, round(rate, 6) AS rate, CAST(row_number() OVER (ORDER BY rate DESC, position) AS INTEGER) AS rank, row_number() OVER (ORDER BY rate DESC, position) <= ceil(0.3 * 4) AS selected FROM f""")
def rank_features_missing(spark, d):
    return r6(aggregates.missing_ranking(_gaps(spark, d), ["f1", "f2", "f3", "f4"], 30.0), "rate")


@query(f"""WITH g AS ({_GAPS}), c AS (SELECT o_orderstatus, (f1 IS NULL)::INT + (f2 IS NULL)::INT AS m, 2 AS n FROM g UNION ALL SELECT o_orderstatus, (f3 IS NULL)::INT + (f4 IS NULL)::INT, 2 FROM g),
s AS (SELECT o_orderstatus, CAST(sum(m) AS BIGINT) AS missing, CAST(sum(n) AS BIGINT) AS cells FROM c GROUP BY 1)
SELECT o_orderstatus, missing, cells, round(missing / cells, 6) AS rate, CAST(row_number() OVER (ORDER BY missing / cells DESC, o_orderstatus) AS INTEGER) AS rank FROM s""")
def rank_groups_missing(spark, d):
    g = _gaps(spark, d)
    return r6(aggregates.group_missing_ranking([(g, ["f1", "f2"]), (g, ["f3", "f4"])], "o_orderstatus"), "rate")


_ATTR = "a AS (SELECT p_size % 5 + 1 AS class, p_size - 25.0 AS f_a, 20.0 - p_size AS f_b, CAST(p_partkey % 7 AS DOUBLE) - 3 AS f_c FROM part), l AS (SELECT class, 'f_a' AS feature, sum(f_a) AS signed FROM a GROUP BY 1 UNION ALL SELECT class, 'f_b', sum(f_b) FROM a GROUP BY 1 UNION ALL SELECT class, 'f_c', sum(f_c) FROM a GROUP BY 1)"


def _attributions(spark, d):
    size = F.col("p_size")
    a = table(spark, d, "part").select((size % 5 + 1).alias("class"), (size - 25.0).alias("f_a"), (20.0 - size).alias("f_b"), ((F.col("p_partkey") % 7).cast("double") - 3).alias("f_c"))
    return aggregates.attribution_sums(a, "class", ["f_a", "f_b", "f_c"], {"f_a": "size", "f_b": "size", "f_c": "key"})


@query(f"WITH {_ATTR} SELECT class, feature, round(signed, 6) AS signed, round(abs(signed), 6) AS size FROM l")
def attribution_sums(spark, d):
    return r6(_attributions(spark, d)[0], "signed", "size")


@query(f"""WITH {_ATTR}, g AS (SELECT class, CASE feature WHEN 'f_c' THEN 'key' ELSE 'size' END AS feature_group, abs(sum(signed)) AS size FROM l GROUP BY 1, 2)
SELECT class, feature_group, round(size, 6) AS size, round(size / sum(size) OVER (PARTITION BY class), 6) AS share FROM g""")
def attribution_groups(spark, d):
    return r6(_attributions(spark, d)[1], "size", "share")


@query(f"WITH {_ATTR} SELECT class, feature, round(abs(signed), 6) AS size, CAST(row_number() OVER (PARTITION BY class ORDER BY abs(signed) DESC, feature) AS INTEGER) AS rank FROM l QUALIFY rank <= 2")
def top_features(spark, d):
    top = windows.top(_attributions(spark, d)[0], ["class"], [F.desc("size"), F.asc("feature")], 2)
    return r6(top.select("class", "feature", "size", "rank"), "size")


@query(f"WITH {PANEL} SELECT entity, month, CAST(row_number() OVER (PARTITION BY entity ORDER BY month) AS INTEGER) AS number FROM panel", dates=("month",))
def running_numbers(spark, d):
    return windows.running_number(panel(spark, d).select("entity", "month"), ["entity"], [F.asc("month")])


@query(f"""WITH {PANEL}, t AS (SELECT entity, label, row_number() OVER (PARTITION BY entity ORDER BY month DESC) AS r FROM panel),
e AS (SELECT entity FROM t WHERE r <= 2 GROUP BY entity HAVING count(DISTINCT label) > 1 OR count(*) = 1)
SELECT entity, month, label FROM panel WHERE entity IN (SELECT entity FROM e) AND month >= DATE '{CUTOFF}'""", dates=("month",))
def phase_change_population(spark, d):
    rows = panel(spark, d).select("entity", "month", "label")
    return windows.changed_entities(rows, "entity", "month", "label").filter(F.col("month") >= F.lit(CUTOFF).cast("date"))


@query("SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) = 1")
def top1_per_entity(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice", "l_partkey")
    return windows.top(rows, ["l_suppkey"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey")]).drop("rank", "l_partkey")


@query("SELECT c_custkey, c_mktsegment, count(*) OVER (PARTITION BY c_mktsegment) AS in_segment, CAST(sum(c_nationkey) OVER (PARTITION BY c_mktsegment) AS BIGINT) AS total FROM customer")
def group_totals(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").withColumn("one", F.lit(1).cast("long"))
    out = windows.with_group_total(windows.with_group_total(rows, ["c_mktsegment"], "one", "in_segment"), ["c_mktsegment"], "c_nationkey", "total")
    return out.drop("one", "c_nationkey")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, d):
    return duplicates(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_values FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def functional_dependency(spark, d):
    return dependency_breaks(table(spark, d, "lineitem"), ["l_returnflag"], ["l_orderkey"])


@query("SELECT event_type, date_part('hour', ts)::INTEGER AS hour, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def events_by_hour(spark, d):
    rows = table(spark, d, "events").groupBy("event_type", F.hour("ts").alias("hour")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows


QUERIES, ORACLE_SQL = query.queries, query.sql
