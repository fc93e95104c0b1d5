"""Joins: validated lookups, comparisons, as-of lookups with fallback, neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..contracts import key_differences, table_digest
from ..functions import EARTH_KM
from ..held import hold
from ..operators import asof, joins, spatial
from ..sources import table
from .base import PANEL, Registry, groups, panel, r6

query = Registry()


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def validated_lookup(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    named = joins.lookup(orders, table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), ["c_custkey"])
    nations = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return joins.lookup(named, nations, ["c_nationkey"]).select("o_orderkey", "c_name", "n_name")


@query(f"WITH {PANEL} SELECT entity, month, c3, label FROM panel", dates=("month",))
def one_to_one_assembly(spark, d):
    p = panel(spark, d)
    return joins.one_to_one(p.select("entity", "month", "c3"), p.select("entity", "month", "label"), ["entity", "month"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def anti_left_only(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.left_only(table(spark, d, "customer").select("c_custkey"), big, ["c_custkey"])


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def isin_semi(spark, d):
    big = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.members(table(spark, d, "customer").select("c_custkey"), big, ["c_custkey"])


@query(f"WITH {PANEL} SELECT entity, month, label FROM panel WHERE entity IN (SELECT entity FROM panel GROUP BY entity HAVING count(*) > 1)", dates=("month",))
def repeated_entity_filter(spark, d):
    p = panel(spark, d).select("entity", "month", "label")
    return joins.repeated_entities(p, p, "entity")


@query("SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem) THEN 'both' ELSE 'left_only' END AS match FROM orders")
def indicator_join(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.matched_flag(table(spark, d, "orders").select("o_orderkey"), lines, ["o_orderkey"])


_TWO = "a AS (SELECT c_custkey AS k, c_acctbal AS v, c_mktsegment AS s FROM customer WHERE c_custkey % 11 <> 0), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS v, c_mktsegment AS s FROM customer WHERE c_custkey % 13 <> 0)"


def _two_tables(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.col("c_mktsegment").alias("s"))
    k = F.col("k")
    return c.filter("k % 11 <> 0"), c.filter("k % 13 <> 0").withColumn("v", F.when(k % 7 == 0, None).when(k % 5 == 0, F.col("v") + 1).otherwise(F.col("v")))


@query(f"WITH {_TWO} SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' ELSE 'different' END AS side FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v OR a.s IS DISTINCT FROM b.s")
def nullsafe_compare(spark, d):
    a, b = _two_tables(spark, d)
    return joins.null_safe_differences(a, b, ["k"], ["v", "s"])


@query(f"""WITH {_TWO}, p AS (SELECT a.v AS av, b.v AS bv, a.s AS sa, b.s AS sb FROM a JOIN b ON a.k = b.k)
SELECT 'v' AS "column", count(*) AS n_rows, count(*) FILTER (WHERE av IS DISTINCT FROM bv) AS n_different, round(max(abs(av - bv)), 6) AS max_gap FROM p
UNION ALL SELECT 's', count(*), count(*) FILTER (WHERE sa IS DISTINCT FROM sb), NULL FROM p""")
def equality_report(spark, d):
    a, b = _two_tables(spark, d)
    return r6(joins.equality_report(a, b, ["k"], ["v", "s"]), "max_gap")


@query(f"WITH {_TWO} (SELECT k, 'left_only' AS side FROM a EXCEPT SELECT k, 'left_only' FROM b) UNION ALL (SELECT k, 'right_only' FROM b EXCEPT SELECT k, 'right_only' FROM a)")
def key_set_differences(spark, d):
    return key_differences(*_two_tables(spark, d), ["k"])


@query("SELECT count(*) AS n_rows, true AS order_free FROM customer")
def table_digests(spark, d):
    """The digest of a table doesn't depend on the order of its rows."""
    c = table(spark, d, "customer")
    a, b = table_digest(c), table_digest(c.orderBy(F.desc("c_custkey"))).withColumnsRenamed({"n_rows": "n2", "digest": "d2"})
    return a.crossJoin(b).select("n_rows", (F.col("digest") == F.col("d2")).alias("order_free"))


@query("""WITH m AS (SELECT c_nationkey AS k, c_mktsegment AS seg, avg(c_acctbal) AS v FROM customer GROUP BY 1, 2), r AS (SELECT k, v AS rv FROM m WHERE seg = 'BUILDING')
SELECT m.k, seg, round(v, 6) AS v, round(v - rv, 6) AS delta_v, round(abs(v - rv), 6) AS abs_delta_v FROM m LEFT JOIN r ON m.k = r.k""")
def reference_deltas(spark, d):
    m = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("seg")).agg(F.avg("c_acctbal").alias("v"))
    return r6(joins.with_reference(m, F.col("seg") == "BUILDING", ["k"], ["v"]), "v", "delta_v", "abs_delta_v")


@query(f"""WITH {PANEL} SELECT p.entity, p.month, max(o.month) AS source_date, arg_max(o.label, o.month) AS source_label
FROM panel p JOIN panel o ON o.entity = p.entity AND o.month < p.month GROUP BY 1, 2""", dates=("month", "source_date"))
def asof_own_history(spark, d):
    p = hold(panel(spark, d).select("entity", "month", "label"))  # targets and observations
    found = asof.latest(p, p, ["entity"], "month", "month", F.struct(F.col("month").alias("d"), F.col("label").alias("v")))
    return found.filter("found IS NOT NULL").select("entity", "month", F.col("found.d").alias("source_date"), F.col("found.v").alias("source_label"))


@query(f"""WITH {PANEL} SELECT p.entity, p.month, max(o.month) AS source_date, arg_max(o.label, o.month) AS source_label
FROM panel p JOIN panel o ON o.entity = p.entity AND o.month <= p.month - INTERVAL 12 MONTH GROUP BY 1, 2""", dates=("month", "source_date"))
def asof_12m_lag(spark, d):
    p = hold(panel(spark, d).select("entity", "month", "label")).withColumn("bound", F.add_months("month", -12))
    found = asof.latest(p, p, ["entity"], "bound", "month", F.struct(F.col("month").alias("d"), F.col("label").alias("v")), inclusive=True)
    return found.filter("found IS NOT NULL").select("entity", "month", F.col("found.d").alias("source_date"), F.col("found.v").alias("source_label"))


_KM = f"2 * {EARTH_KM} * atan2(sqrt(a), sqrt(greatest(1 - a, 0)))"
_HAV = "pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)"


def _fallback(lag: int) -> str:
    op = f"<= p.month - INTERVAL {lag} MONTH" if lag else "< p.month"
    tier = lambda n, cond: f"""
{n}_date AS (SELECT p.entity, p.month, max(o.month) AS d FROM left_{n} p JOIN obs o ON {cond} AND o.month {op} GROUP BY 1, 2),
{n}_met AS (SELECT a.entity, a.month, b.entity AS e, b.month AS d, b.label AS v, {_HAV} AS a FROM {n}_date x JOIN obs a ON a.entity = x.entity AND a.month = x.month JOIN obs b ON b.month = x.d AND {cond.replace("o.", "b.").replace("p.", "a.")}),
{n}_km AS (SELECT *, {_KM} AS km FROM {n}_met),
{n} AS (SELECT entity, month, '{n}' AS source, min(e) AS source_entity, any_value(d) AS source_date, arg_min(v, e) AS source_value
  FROM (SELECT *, min(km) OVER (PARTITION BY entity, month) AS least FROM {n}_km) WHERE km <= least + 1e-9 GROUP BY 1, 2)"""  # noqa: E731
    return f"""WITH {PANEL}, obs AS (SELECT entity, month, label, lat, lon, grp FROM panel JOIN groups USING (entity)),
own AS (SELECT p.entity, p.month, 'own' AS source, p.entity AS source_entity, max(o.month) AS source_date, arg_max(o.label, o.month) AS source_value
  FROM obs p JOIN obs o ON o.entity = p.entity AND o.month {op} GROUP BY p.entity, p.month),
left_group AS (SELECT * FROM obs ANTI JOIN own USING (entity, month)), {tier("group", "o.grp = p.grp")},
left_global AS (SELECT * FROM left_group ANTI JOIN "group" USING (entity, month)), {tier("global", "true")},
found AS (SELECT * FROM own UNION ALL SELECT * FROM "group" UNION ALL SELECT * FROM "global")
SELECT source, count(*) AS n, sum(source_entity)::BIGINT AS entities, sum(source_value)::BIGINT AS labels, sum(date_diff('day', DATE '1990-01-01', source_date))::BIGINT AS days
FROM obs LEFT JOIN found USING (entity, month) WHERE source IS NOT NULL GROUP BY source""".replace(" group AS (", ' "group" AS (').replace(" global AS (", ' "global" AS (').replace("\ngroup AS (", '\n"group" AS (').replace("\nglobal AS (", '\n"global" AS (')


def _persistence(spark, d, lag):
    p = hold(panel(spark, d).join(groups(spark, d), "entity").select("entity", "month", "grp", "lat", "lon", "label"))  # targets and observations
    found = asof.with_fallback(p, p, "entity", "month", "grp", "lat", "lon", "label", lag)
    day = F.datediff("source_date", F.lit("1990-01-01").cast("date"))
    return found.filter("source IS NOT NULL").groupBy("source").agg(F.count("*").alias("n"), F.sum("source_entity").alias("entities"), F.sum("source_value").alias("labels"), F.sum(day).alias("days"))


@query(_fallback(0))
def asof_fallback_persistence(spark, d):
    return _persistence(spark, d, 0)


@query(_fallback(12))
def asof_fallback_12m(spark, d):
    return _persistence(spark, d, 12)


def _points(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), ((k * 37 % 1700) / 10 - 85).alias("lat"), ((k * 91 % 3600) / 10 - 180).alias("lon"), F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("bal"))


_POINTS = "points AS (SELECT s_suppkey AS id, CAST(s_suppkey * 37 % 1700 AS DOUBLE) / 10 - 85 AS lat, CAST(s_suppkey * 91 % 3600 AS DOUBLE) / 10 - 180 AS lon, s_nationkey AS g, s_acctbal AS bal FROM supplier)"
_EDGES = f"pairs AS (SELECT a.id AS src, b.id AS dst, 2 * {EARTH_KM} * asin(sqrt(least(greatest({_HAV}, 0), 1))) AS km FROM points a JOIN points b ON a.id <> b.id), knn AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY km, dst) AS rank FROM pairs QUALIFY rank <= 5)"


@query(f"WITH {_POINTS}, {_EDGES} SELECT src, dst, round(km, 6) AS km, CAST(rank AS INTEGER) AS rank FROM knn")
def knn5_neighbors(spark, d):
    return r6(spatial.nearest(_points(spark, d), "id", "lat", "lon", 5), "km")


@query(f"WITH {_POINTS}, {_EDGES} SELECT src, dst, round(km, 6) AS km FROM pairs WHERE km <= 1500")
def radius_neighbors(spark, d):
    p = _points(spark, d)
    return r6(spatial.within(p, p, "id", "lat", "lon", 1500.0), "km")


@query(f"""WITH {_POINTS}, {_EDGES}, v AS (SELECT id, CAST(m AS INTEGER) AS month, CASE WHEN (id + m) % 3 <> 0 THEN bal + m END AS bal FROM points, range(1, 4) t(m))
SELECT src AS id, month, round(avg(bal), 6) AS bal_mean, count(bal) AS bal_n FROM knn JOIN v ON v.id = knn.dst GROUP BY 1, 2""")
def neighbor_mean(spark, d):
    p = _points(spark, d)
    v = p.select("id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("month"), "bal").withColumn("bal", F.when((F.col("id") + F.col("month")) % 3 != 0, F.col("bal") + F.col("month")))
    return r6(spatial.neighbour_mean(spatial.nearest(p, "id", "lat", "lon", 5), v, "id", "month", ["bal"]), "bal_mean")


@query(f"""WITH {_POINTS}, {_EDGES}, e AS (SELECT * FROM pairs WHERE km <= 800)
SELECT id, count(dst) AS n, round(min(km), 6) AS min_km, round(avg(km), 6) AS mean_km, round(max(km), 6) AS max_km, coalesce(string_agg(dst, ';' ORDER BY km, dst), '') AS ids,
  count(dst) = 0 AS no_neighbour, sha256(coalesce(string_agg(dst, ';' ORDER BY km, dst), '')) AS ids_hash FROM points LEFT JOIN e ON src = id GROUP BY id""")
def weight_diagnostics(spark, d):
    p = _points(spark, d)
    return r6(spatial.edge_diagnostics(p, spatial.within(p, p, "id", "lat", "lon", 800.0), "id"), "min_km", "mean_km", "max_km")


@query(f"""WITH {_POINTS}, {_EDGES}, months AS (SELECT make_date(2020, CAST(m AS INTEGER), 1) AS month FROM range(1, 7) t(m)),
obs AS (SELECT id, month, bal + month(month) AS v FROM points, months WHERE (id * 7 + month(month) * 3) % 5 < 2 AND id % 6 <> 0),
slots AS (SELECT src, dst, month FROM knn, months WHERE rank <= 3 AND month >= DATE '2020-03-01'),
own AS (SELECT src, dst, month, value, dst AS source, CASE WHEN mx = month THEN 'observed' ELSE 'own' END AS method FROM (
  SELECT src, dst, s.month AS month, arg_max(v, o.month) AS value, max(o.month) AS mx FROM slots s JOIN obs o ON o.id = s.dst AND o.month <= s.month GROUP BY src, dst, s.month)),
rest1 AS (SELECT * FROM slots ANTI JOIN own USING (src, dst, month)),
latest AS (SELECT m.month AS permitted, id, max(o.month) AS d, arg_max(v, o.month) AS v FROM obs o JOIN months m ON o.month <= m.month GROUP BY 1, 2),
c1 AS (SELECT r.src, r.dst, r.month, l.id AS source, l.d, l.v, {_HAV} AS h FROM rest1 r JOIN points a ON a.id = r.dst JOIN latest l ON l.permitted = r.month JOIN points b ON b.id = l.id
  WHERE a.g = b.g AND l.id <> r.dst AND l.id <> r.src),
grp AS (SELECT src, dst, month, v AS value, source, 'group' AS method FROM c1 QUALIFY row_number() OVER (PARTITION BY src, dst, month ORDER BY d DESC, asin(sqrt(least(h, 1))), source) = 1),
rest2 AS (SELECT * FROM rest1 ANTI JOIN grp USING (src, dst, month)),
c2 AS (SELECT r.src, r.dst, r.month, l.id AS source, l.d, l.v, {_HAV} AS h FROM rest2 r JOIN points a ON a.id = r.dst JOIN latest l ON l.permitted = r.month JOIN points b ON b.id = l.id
  WHERE l.id <> r.dst AND l.id <> r.src),
anywhere AS (SELECT src, dst, month, v AS value, source, 'global' AS method FROM c2 QUALIFY row_number() OVER (PARTITION BY src, dst, month ORDER BY d DESC, asin(sqrt(least(h, 1))), source) = 1),
every AS (SELECT * FROM own UNION ALL SELECT * FROM grp UNION ALL SELECT * FROM anywhere)
SELECT src, dst, month, round(value, 6) AS value, source, method FROM every""", dates=("month",))
def slot_imputation(spark, d):
    p = _points(spark, d)
    months = spark.range(1, 7).select(F.make_date(F.lit(2020), F.col("id").cast("int"), F.lit(1)).alias("month"))
    m = F.month("month")
    obs = p.crossJoin(F.broadcast(months)).filter(((F.col("id") * 7 + m * 3) % 5 < 2) & (F.col("id") % 6 != 0)).select("id", "month", (F.col("bal") + m).alias("v"))
    edges = spatial.nearest(p, "id", "lat", "lon", 3)
    targets = p.select("id").crossJoin(F.broadcast(months.filter("month >= '2020-03-01'")))
    return r6(spatial.impute_slots(edges, targets, obs, p, "id", "month", "g", "lat", "lon", "v").filter("method IS NOT NULL"), "value")


@query(f"""WITH {_POINTS}, c AS (SELECT c_custkey AS c, CAST(c_custkey * 37 % 1700 AS DOUBLE) / 10 - 85 AS lat, CAST(c_custkey * 91 % 3600 AS DOUBLE) / 10 - 180 AS lon FROM customer),
p AS (SELECT c.c, points.id, (c.lat - points.lat) * (c.lat - points.lat) + (c.lon - points.lon) * (c.lon - points.lon) AS d2 FROM c, points)
SELECT c, id, round(d2, 6) AS d2 FROM p QUALIFY row_number() OVER (PARTITION BY c ORDER BY d2, id) = 1""")
def nearest_grid_point(spark, d):
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(k.alias("c"), ((k * 37 % 1700) / 10 - 85).alias("lat"), ((k * 91 % 3600) / 10 - 180).alias("lon"))
    return r6(spatial.nearest_planar(points, _points(spark, d), "c", "id", "lat", "lon"), "d2")


QUERIES, ORACLE_SQL = query.queries, query.sql
