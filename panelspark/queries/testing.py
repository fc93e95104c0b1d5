"""Tests and intervals: balance, association, adjusted p-values, bootstrap."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bootstrap, metrics, statistics
from ..sources import table
from .base import PREDICTIONS, Registry, predictions, r6

query = Registry()


def _smd_sql(c: str) -> str:
    a, b = f"CASE WHEN x = 1 THEN {c} END", f"CASE WHEN x = 0 THEN {c} END"
    return f"""SELECT '{c}' AS "column", round(avg({a}), 6) AS mean_1, round(avg({b}), 6) AS mean_0, round((avg({a}) - avg({b})) / sqrt((var_samp({a}) + var_samp({b})) / 2), 6) AS smd FROM t"""


@query(f"WITH t AS (SELECT (l_returnflag = 'R')::INT AS x, l_quantity, l_extendedprice FROM lineitem) {_smd_sql('l_quantity')} UNION ALL {_smd_sql('l_extendedprice')}")
def smd_balance(spark, d):
    t = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("x"), "l_quantity", "l_extendedprice")
    return r6(statistics.smd(t, "x", ["l_quantity", "l_extendedprice"]), "mean_1", "mean_0", "smd")


_CHI = """t AS (SELECT source, lang, (quality IS NULL)::INT AS miss FROM documents LEFT JOIN labels USING (doc_id)),
c AS (SELECT lang, source, count(*) AS n, sum(miss) AS k FROM t GROUP BY 1, 2 HAVING count(*) >= 10),
w AS (SELECT *, sum(n) OVER (PARTITION BY lang) AS nn, sum(k) OVER (PARTITION BY lang) AS kk FROM c), e AS (SELECT *, n * kk / nn AS e1, n * (nn - kk) / nn AS e0 FROM w),
s AS (SELECT lang, count(*) AS n_groups, max(nn) AS n, max(kk) AS ones, sum(CASE WHEN e1 > 0 THEN pow(k - e1, 2) / e1 ELSE 0 END + CASE WHEN e0 > 0 THEN pow(n - k - e0, 2) / e0 ELSE 0 END) AS chi2,
  sum((e1 < 5)::INT + (e0 < 5)::INT) AS under_5, sum((e1 < 1)::INT + (e0 < 1)::INT) AS under_1 FROM e GROUP BY lang)"""


@query(f"""WITH {_CHI}, a AS (SELECT *, n_groups > 1 AND ones > 0 AND ones < n AS able FROM s)
SELECT lang, n_groups, CAST(n AS BIGINT) AS n, CAST(ones AS BIGINT) AS ones, CASE WHEN able THEN round(chi2, 6) END AS chi2, CAST(under_5 AS BIGINT) AS under_5, CAST(under_1 AS BIGINT) AS under_1, n_groups - 1 AS df,
  CASE WHEN NOT able THEN 'not_estimable' WHEN under_5 > 0.4 * n_groups OR under_1 > 0 THEN 'sparse' ELSE 'ok' END AS status, CASE WHEN able THEN round(sqrt(chi2 / n), 6) END AS cramers_v,
  CASE WHEN able THEN round(1 - list_sum(list_transform(range(0, 400), lambda k: exp((df0 / 2.0 + k) * ln(greatest(chi2, 1e-300) / 2) - chi2 / 2 - lgamma(df0 / 2.0 + k + 1)))), 6) END AS p_value FROM (SELECT *, n_groups - 1 AS df0 FROM a)""")
def chi2_cramers_v(spark, d):
    t = table(spark, d, "documents").select("doc_id", "source", "lang").join(table(spark, d, "labels"), "doc_id", "left").withColumn("miss", F.col("quality").isNull().cast("int"))
    return r6(statistics.association(t, ["lang"], "source", "miss", 10), "chi2", "cramers_v", "p_value")


@query("""WITH c AS (SELECT o_custkey, count(*) AS n, sum((o_orderstatus = 'F')::INT) AS k FROM orders GROUP BY 1 HAVING count(*) >= 5), t AS (SELECT sum(n) AS nn, sum(k) AS kk, count(*) AS g FROM c),
s AS (SELECT max(g) AS n_groups, max(nn) AS n, sum(pow(k - n * kk / nn, 2) / (n * kk / nn) + pow(n - k - n * (nn - kk) / nn, 2) / (n * (nn - kk) / nn)) AS chi2 FROM c, t)
SELECT n_groups, CAST(n AS BIGINT) AS n, n_groups - 1 AS df, round(chi2, 6) AS chi2,
  round(greatest(0, 1 - list_sum(list_transform(range(0, 40000), lambda k: exp((df0 / 2.0 + k) * ln(chi2 / 2) - chi2 / 2 - lgamma(df0 / 2.0 + k + 1))))), 6) AS p_value FROM (SELECT *, n_groups - 1 AS df0 FROM s)""")
def chi2_many_groups(spark, d):
    """One group a customer, so that statistic and degrees run into thousands."""
    rows = table(spark, d, "orders").select("o_custkey", (F.col("o_orderstatus") == "F").cast("int").alias("f"))
    return r6(statistics.association(rows, [], "o_custkey", "f", 5), "chi2", "p_value").select("n_groups", "n", "df", "chi2", "p_value")


_PS = "p AS (SELECT p_size % 3 AS family, p_partkey, CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE (p_partkey % 50 + 1) / 100.0::DOUBLE END AS p_value FROM part)"


def _ps(spark, d):
    k = F.col("p_partkey")
    return table(spark, d, "part").select((F.col("p_size") % 3).alias("family"), k.alias("p_partkey"), F.when(k % 17 != 0, (k % 50 + 1) / 100).alias("p_value"))


@query(f"""WITH {_PS}, r AS (SELECT *, p_value * count(p_value) OVER (PARTITION BY family) / count(p_value) OVER (PARTITION BY family ORDER BY p_value) AS q FROM p WHERE p_value IS NOT NULL)
SELECT family, p_partkey, p_value, round(least(1, min(q) OVER (PARTITION BY family ORDER BY p_value DESC)), 6) AS q_value FROM r UNION ALL SELECT family, p_partkey, NULL, NULL FROM p WHERE p_value IS NULL""")
def bh_adjust(spark, d):
    return r6(statistics.benjamini_hochberg(_ps(spark, d), ["family"]), "q_value")


@query(f"""WITH {_PS}, r AS (SELECT family, p_value, count(*) AS c FROM p WHERE p_value IS NOT NULL GROUP BY 1, 2), k AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY family ORDER BY p_value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below, sum(c) OVER (PARTITION BY family) AS m FROM r)
SELECT family, p_value, round(least(1, max(p_value * (m - below)) OVER (PARTITION BY family ORDER BY p_value)), 6) AS p_holm FROM k""")
def holm_adjust(spark, d):
    """The adjusted value of tied tests is that of the first of them."""
    return r6(statistics.holm(_ps(spark, d), ["family"]).filter("p_value IS NOT NULL").groupBy("family", "p_value").agg(F.min("p_holm").alias("p_holm")), "p_holm")


@query("""WITH t AS (SELECT (l_returnflag = 'R')::INT AS x, l_quantity AS y, l_suppkey AS g FROM lineitem), m AS (SELECT count(*) AS n, sum(x) AS n1, avg(y) FILTER (WHERE x = 1) AS m1, avg(y) FILTER (WHERE x = 0) AS m0 FROM t),
s AS (SELECT g, sum(CASE WHEN x = 1 THEN y - m1 ELSE 0 END) / any_value(n1) - sum(CASE WHEN x = 0 THEN y - m0 ELSE 0 END) / any_value(n - n1) AS i FROM t, m GROUP BY g),
v AS (SELECT count(*) AS c, sum(i * i) AS v FROM s)
SELECT round(m1 - m0, 6) AS estimate, round(sqrt(v * c / (c - 1) * (n - 1) / (n - 2)), 6) AS se, c AS clusters, n, round((m1 - m0) / sqrt(v * c / (c - 1) * (n - 1) / (n - 2)), 4) AS t FROM m, v""")
def clustered_difference(spark, d):
    rows = table(spark, d, "lineitem").withColumn("x", (F.col("l_returnflag") == "R").cast("int"))
    out = statistics.clustered_difference(rows, "x", "l_quantity", "l_suppkey")
    return r6(out, "estimate", "se").withColumn("t", F.round("t", 4)).drop("p_value")


def _counts(spark, d):
    rows = predictions(spark, d)
    parts = metrics.binary_parts(F.col("actual"), F.col("predicted"))
    return rows.groupBy("grp").agg(F.count("*").alias("n"), *(c.alias(k) for k, c in parts.items()), F.sum((F.col("actual") == F.col("predicted")).cast("long")).alias("hits"))


@query(f"""WITH {PREDICTIONS}, c AS (SELECT grp, count(*) AS n, count(*) FILTER (WHERE actual >= 3 AND predicted >= 3) AS tp, count(*) FILTER (WHERE actual < 3 AND predicted >= 3) AS fp, count(*) FILTER (WHERE actual >= 3 AND predicted < 3) AS fn, count(*) FILTER (WHERE actual = predicted) AS hits FROM predictions GROUP BY grp),
k AS (SELECT *, row_number() OVER (ORDER BY grp) - 1 AS r FROM c), draws AS (SELECT draw, (draw * 7 + slot * (draw % 5 + 1)) % 25 AS r, count(*) AS times FROM range(200) a(draw), range(25) b(slot) GROUP BY 1, 2),
s AS (SELECT draw, sum(n * times) AS n, sum(tp * times) AS tp, sum(fp * times) AS fp, sum(fn * times) AS fn, sum(hits * times) AS hits FROM draws JOIN k USING (r) GROUP BY draw),
l AS (SELECT 'accuracy' AS statistic, hits / n AS v FROM s UNION ALL SELECT 'precision', tp / nullif(tp + fp, 0) FROM s UNION ALL SELECT 'recall', tp / nullif(tp + fn, 0) FROM s)
SELECT statistic, count(v) AS n_draws, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.025), 6) AS low, round(quantile_cont(v, 0.975), 6) AS high FROM l GROUP BY statistic""")
def cluster_bootstrap_ci(spark, d):
    """With a given table of draws, so that SQL can follow."""
    counts = _counts(spark, d)
    numbered = counts.select("grp", (F.expr("row_number() over (order by grp)") - 1).alias("r"))
    draw, slot = F.col("draw"), F.col("slot")
    drawn = spark.range(200).withColumnRenamed("id", "draw").withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(24)))).select("draw", ((draw * 7 + slot * (draw % 5 + 1)) % 25).alias("r"))
    drawn = drawn.groupBy("draw", "r").agg(F.count("*").alias("times")).join(numbered, "r").drop("r")
    stats = {"accuracy": F.col("hits") / F.col("n"), "precision": metrics.ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": metrics.ratio(F.col("tp"), F.col("tp") + F.col("fn"))}
    return r6(bootstrap.intervals(counts, drawn, "grp", stats), "mean", "low", "high")


@query("SELECT draw, CAST(25 AS BIGINT) AS drawn FROM range(100) t(draw)")
def bootstrap_draw_sizes(spark, d):
    """Every hashed draw has as many clusters as there are."""
    clusters = table(spark, d, "nation").select(F.col("n_name").alias("grp"))
    return bootstrap.draws(spark, clusters, "grp", 100).groupBy("draw").agg(F.sum("times").alias("drawn"))


QUERIES, ORACLE_SQL = query.queries, query.sql
