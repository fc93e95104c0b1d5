"""Hand-made cases of the panel operators."""

import datetime
import math
import random

import numpy as np
import pytest
from panelspark import contracts, functions as X
from panelspark.operators import asof, joins, metrics, spatial, splits, statistics, windows
from pyspark.sql import functions as F


def test_shares_and_labels(spark):
    rows = [(0.1, 0.2, 0.3, None, 0.4), (0.5, 0.3, 0.0, 0.0, 0.2), (1.0, 0.0, 0.0, 0.0, 0.0), (0.2, 0.2, 0.2, 0.2, float("nan"))]
    df = spark.createDataFrame(rows, "s1 double, s2 double, s3 double, s4 double, s5 double")
    cols = [F.col(f"s{k}") for k in range(1, 6)]
    skip, strict = X.cumulative_shares(cols), X.cumulative_shares(cols, skip_null=False)
    got = df.select(skip[3].alias("a"), strict[3].alias("b"), X.majority_label({k: X.null_missing(c) for k, c in skip.items()}).alias("label")).collect()
    assert abs(got[0].a - 0.7) < 1e-12 and got[0].b is None
    assert [r.label for r in got] == [5, 5, 1, 1]


def test_rounding_is_half_even_on_the_scaled_value(spark):
    xs = [0.005, 0.015, 0.285, 0.575, 1.005, -0.005, 0.195, 0.194]
    got = [r.x for r in spark.createDataFrame([(x,) for x in xs], "x double").select(X.round_even(F.col("x")).alias("x")).collect()]
    assert got == [float(np.round(x, 2)) for x in xs]


def test_isotonic_fit(spark):
    rng = np.random.default_rng(1)
    ys = rng.uniform(-0.2, 1.2, (200, 4))
    df = spark.createDataFrame([tuple(map(float, y)) for y in ys], "a double, b double, c double, d double")
    got = df.select(*X.isotonic_decreasing([F.col(c) for c in "abcd"])).collect()

    def pav(y):
        blocks = []
        for v in y:
            blocks.append([v, 1])
            while len(blocks) > 1 and blocks[-2][0] < blocks[-1][0]:
                (v1, n1), (v2, n2) = blocks[-2], blocks[-1]
                blocks[-2:] = [[(v1 * n1 + v2 * n2) / (n1 + n2), n1 + n2]]
        return np.clip([v for v, n in blocks for _ in range(n)], 0, 1)

    assert np.allclose([list(r) for r in got], [pav(y) for y in ys])


def test_splits_cover_once(spark):
    df = spark.sql("select explode(sequence(date'1996-01-01', date'2001-12-01', interval 1 month)) m, 'a' g")
    assert {r["s"]: r["count"] for r in df.select(splits.three_way(F.col("m"), "1997-12-01", "1999-01-01").alias("s")).groupBy("s").count().collect()} == {"train": 24, "calibration": 12, "test": 36}
    with pytest.raises(contracts.ContractError):
        splits.three_way(F.col("m"), "1999-01-01", "1999-01-01")
    assert sorted(splits.shuffled_folds(list(range(11)), 5)) == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]


def test_quotas(spark):
    sizes = spark.createDataFrame([("a", 1), ("b", 3), ("c", 10)], "g string, n long")
    got = {r.g: r.quota for r in splits.quotas(sizes, "g", "n", 5).collect()}
    assert got == {"a": 1, "b": 1, "c": 3} and sum(got.values()) == 5


def test_validated_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    with pytest.raises(contracts.ContractError, match="no match"):
        joins.lookup(a, a.filter("k = 1").select("k"), ["k"])
    with pytest.raises(contracts.ContractError, match="repeated"):
        joins.lookup(a, a.select("k").unionByName(a.select("k")), ["k"])
    with pytest.raises(contracts.ContractError, match="one side"):
        joins.one_to_one(a, a.filter("k = 1").select("k"), ["k"])
    contracts.require_same_keys(a, a, ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.require_all(a, {"small": F.col("k") < 2})
    contracts.require_counts(a, rows=2, v=2)


def test_asof_tiers_and_ties(spark):
    obs = spark.createDataFrame(
        [(1, "2020-01-01", "A", 0.0, 0.0, 10), (7, "2020-03-01", "B", 0.0, 1.0, 70), (3, "2020-03-01", "B", 0.0, -1.0, 30), (8, "2020-02-01", "B", 0.0, 0.01, 80)],
        "e long, d string, g string, lat double, lon double, v int",
    ).withColumn("d", F.to_date("d"))
    targets = spark.createDataFrame([(1, "2020-05-01", "A"), (9, "2020-05-01", "B"), (10, "2020-05-01", "C"), (11, "2019-01-01", "A")], "e long, d string, g string").withColumns({"d": F.to_date("d"), "lat": F.lit(0.0), "lon": F.lit(0.0)})
    got = {r.e: (r.source, r.source_entity, r.source_value) for r in asof.with_fallback(targets, obs, "e", "d", "g", "lat", "lon", "v").collect()}
    # newer beats nearer (8 is nearest but older); of 7 and 3, equally far, the least id
    assert got == {1: ("own", 1, 10), 9: ("group", 3, 30), 10: ("global", 3, 30), 11: (None, None, None)}


def test_asof_carries_over_periods(spark):
    obs = spark.createDataFrame([(1, "2015-06-01", 5)], "e long, d string, v int").withColumn("d", F.to_date("d"))
    t = spark.createDataFrame([(1, "2020-01-01"), (1, "2015-06-01"), (2, "2020-01-01")], "e long, d string").withColumn("d", F.to_date("d"))
    value = F.struct(F.col("d").alias("d"), F.col("v").alias("v"))
    find = lambda inclusive: sorted((r.e, str(r.d), r.found and r.found.v) for r in asof.latest(t, obs, ["e"], "d", "d", value, inclusive).collect())
    assert find(False) == [(1, "2015-06-01", None), (1, "2020-01-01", 5), (2, "2020-01-01", None)]
    assert find(True)[0] == (1, "2015-06-01", 5)


def test_neighbours_with_equal_places(spark):
    pts = spark.createDataFrame([(k, 10.0, 20.0) for k in range(4)] + [(10, 10.0, 21.0), (11, -80.0, 179.0), (12, -80.0, -179.0)], "id long, lat double, lon double")
    near = spatial.nearest(pts, "id", "lat", "lon", 3).filter("src = 2").orderBy("rank").collect()
    assert [r.dst for r in near] == [0, 1, 3] and all(r.km == 0 for r in near)
    assert spatial.nearest(pts, "id", "lat", "lon", 5).count() == 7 * 5
    km = spatial.within(pts, pts, "id", "lat", "lon", 60.0).filter("src = 11").collect()
    assert [r.dst for r in km] == [12]
    d = spatial.within(pts, pts, "id", "lat", "lon", 150.0).filter("src = 10 and dst = 0").first().km
    assert spatial.within(pts, pts, "id", "lat", "lon", d).filter("src = 10 and dst = 0").count() == 1


def test_metrics_edges(spark):
    rows = [("none_predicted", 3, 1, 0.5, 0.1), ("none_predicted", 1, 1, 0.1, 0.1), ("none_actual", 1, 3, 0.1, 0.4), ("none_actual", 2, 2, 0.2, 0.1), ("one", 3, 3, 0.4, 0.4), ("flat", 1, 1, 0.1, 0.1), ("flat", 1, 1, 0.1, 0.2)]
    got = {r.g: r for r in metrics.evaluate(spark.createDataFrame(rows, "g string, actual int, predicted int, y double, p double"), ["g"]).collect()}
    assert got["none_predicted"].precision is None and got["none_predicted"].precision_reason == "no_predicted_positive" and got["none_predicted"].recall == 0
    assert got["none_actual"].recall_reason == "no_actual_positive" and got["one"].r2_reason == "insufficient_observations" and got["flat"].r2_reason == "constant_actual_share"


def test_transitions(spark):
    df = spark.createDataFrame([(2, 3), (2, 2), (3, 2), (4, 4)], "a int, b int")
    r = metrics.change_counts(df, "a", "b").first()
    assert (r.promotions, r.demotions, r.unchanged) == (1, 1, 2)
    assert metrics.confusion(df, [], "a", "b").count() == 25


def test_tails(spark):
    got = spark.sql("select explode(array(0.5d, 3.84145882069412d, 30d)) x").withColumn("p", statistics.chi2_tail(F.col("x"), F.lit(1))).collect()
    for r in got:
        assert abs(r.p - math.erfc(math.sqrt(r.x / 2))) < 1e-9
    t = spark.sql("select explode(array(0d, 1d, 12.706204736432095d)) t").withColumn("p", statistics.t_tail(F.col("t"), F.lit(1))).collect()
    for r in t:
        assert abs(r.p - (1 - 2 * math.atan(r.t) / math.pi)) < 1e-8


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([("f", 0.01), ("f", 0.02), ("f", 0.02), ("f", None), ("f", 0.9)], "g string, p_value double")
    got = sorted((r.p_value, r.q_value) for r in statistics.benjamini_hochberg(df, ["g"]).filter("p_value is not null").collect())
    want = [(0.01, 0.02 * 4 / 3), (0.02, 0.02 * 4 / 3), (0.02, 0.02 * 4 / 3), (0.9, 0.9)]
    assert np.allclose(got, want)


def test_changed_entities(spark):
    df = spark.createDataFrame([(1, 1, 3), (1, 2, 3), (1, 3, 4), (2, 1, 2), (2, 2, 2), (3, 1, 5)], "e long, d int, label int")
    assert {r.e for r in windows.changed_entities(df, "e", "d", "label").collect()} == {1, 3}


@pytest.mark.parametrize("name", ["bh_adjust", "holm_adjust"])
def test_adjusting_a_whole_table(spark, name):
    """Over all of part; windows see distinct values only."""
    import duckdb
    from panelspark.queries import testing

    k, d = F.col("p_partkey"), "/root/testdata/sf0.01/part.parquet"
    rows = spark.read.parquet(d).select((F.col("p_size") % 3).alias("family"), "p_partkey", F.when(k % 17 != 0, (k % 50 + 1) / 100).alias("p_value"))
    sql = testing.ORACLE_SQL[name].replace("FROM part)", f"FROM '{d}')")
    if name == "bh_adjust":
        got, value, keys = statistics.benjamini_hochberg(rows, ["family"]), "q_value", ["family", "p_partkey", "p_value"]
    else:
        got, value, keys = statistics.holm(rows, ["family"]), "p_holm", ["family", "p_value"]
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and plan.rindex("Window [") < plan.rindex("Aggregate")
    assert got.columns == ["family", "p_partkey", "p_value", value] and got.count() == rows.count() == 2000
    got = got.filter("p_value is not null").select(*keys, value).distinct() if name == "holm_adjust" else got
    show = lambda rs: sorted(tuple("" if v is None else f"{v:.6f}" for v in r) for r in rs)
    assert show(got.select(*keys, value).collect()) == show(duckdb.sql(f"SELECT {', '.join(keys)}, {value} FROM ({sql})").fetchall())


def _km(a, b):
    la, lo, lb, lp = map(math.radians, (*a, *b))
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


def test_fallback_returns_every_target_and_the_nearest(spark):
    rnd = random.Random(4)
    month = lambda k: datetime.date(2020 + k // 12, k % 12 + 1, 1)
    place = lambda: (None, None) if rnd.random() < 0.15 else (float("nan"), 1.0) if rnd.random() < 0.1 else (rnd.uniform(-80, 80), rnd.uniform(-180, 180))
    obs = [(e, month(rnd.randrange(12)), rnd.choice("ab"), *place(), rnd.randrange(9)) for e in range(60) for _ in range(2)]
    obs += [(500, month(0), "c", None, None, 1), (501, month(0), "c", None, None, 2), (None, month(3), "a", 1.0, 1.0, 3), (502, None, "a", 1.0, 1.0, 3)]
    targets = [(1000 + k, month(rnd.randrange(14)), rnd.choice(["a", "b", "c", "z", None]), *place(), "x") for k in range(80)] + [(e, month(13), "a", 0.0, 0.0, "own") for e in range(5)]
    targets += [targets[3], targets[3], targets[81], (2000, None, "a", 0.0, 0.0, "no date"), (2001, month(0), "a", 0.0, 0.0, "nothing before")]
    o = spark.createDataFrame(obs, "entity long, month date, grp string, lat double, lon double, label int")
    t = spark.createDataFrame(targets, "entity long, month date, grp string, lat double, lon double, extra string")
    got = asof.with_fallback(t, o, "entity", "month", "grp", "lat", "lon", "label").collect()
    assert len(got) == len(targets)
    known = lambda *xs: all(x is not None and not math.isnan(x) for x in xs)
    for r in got:
        before = [x for x in obs if x[1] is not None and r.month is not None and x[1] < r.month]
        tiers = [("own", [x for x in before if x[0] == r.entity]), ("group", [x for x in before if x[2] == r.grp and r.grp is not None]), ("global", before)]
        tier, some = next(((n, c) for n, c in tiers if c), (None, []))
        assert r.source == tier, r
        if tier:
            latest = [x for x in some if x[1] == max(y[1] for y in some)]
            assert r.source_date == latest[0][1]
            if tier != "own":
                far = [_km((r.lat, r.lon), x[3:5]) if known(r.lat, r.lon, *x[3:5]) else math.inf for x in latest]
                best = [x for x, km in zip(latest, far, strict=True) if km <= min(far) + 1e-9]
                assert r.source_entity == min((x[0] for x in best), key=lambda e: (e is not None, e)), r
    assert asof.with_fallback(t.limit(0), o, "entity", "month", "grp", "lat", "lon", "label").collect() == []
    assert [r.source for r in asof.with_fallback(t.limit(2), o.limit(0), "entity", "month", "grp", "lat", "lon", "label").collect()] == [None, None]


def test_nearest_in_crowded_and_empty_places(spark):
    rnd = random.Random(5)
    points = [(k, 48.0 + rnd.gauss(0, 1e-4), 2.0 + rnd.gauss(0, 1e-4)) for k in range(150)] + [(200 + k, 10.0, 10.0) for k in range(12)] + [(300 + k, rnd.uniform(-90, 90), rnd.uniform(-180, 180)) for k in range(30)] + [(400, 90.0, 0.0), (401, -90.0, 77.0), (402, None, 1.0), (403, float("nan"), 1.0)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    got = {}
    for r in spatial.nearest(df, "id", "lat", "lon", 4).collect():
        got.setdefault(r.src, []).append((r["rank"], round(r.km, 6), r.dst))
    placed = [p for p in points if p[1] is not None and not math.isnan(p[1])]
    assert set(got) == {p[0] for p in placed}
    for i, *at in placed:
        want = sorted((round(_km(at, p[1:]), 6), p[0]) for p in placed if p[0] != i)[:4]
        assert [km for _, km, _ in sorted(got[i])] == [km for km, _ in want]
        if 200 <= i < 300:
            assert [d for _, _, d in sorted(got[i])] == [d for _, d in want]
    assert spatial.nearest(df.limit(1), "id", "lat", "lon", 4).collect() == [] and spatial.nearest(df.limit(0), "id", "lat", "lon", 4).collect() == []
    assert len(spatial.nearest(df.limit(3), "id", "lat", "lon", 4).collect()) == 6


def test_nearest_node_on_a_plane(spark):
    rnd = random.Random(6)
    nodes = [(k, rnd.uniform(0, 5), rnd.uniform(0, 5)) for k in range(40)] + [(90, 1.0, 1.0), (91, 1.0, 1.0), (92, float("nan"), 1.0), (93, None, 0.0)]
    points = [(k, rnd.uniform(-20, 20), rnd.uniform(-20, 20)) for k in range(60)] + [(99, 1.0, 1.0), (100, float("nan"), 1.0), (101, 1.0, None)]
    df = lambda rows, name: spark.createDataFrame(rows, f"{name} long, x double, y double")
    got = {r.p: (r.g, r.d2) for r in spatial.nearest_planar(df(points, "p"), df(nodes, "g"), "p", "g", "x", "y").collect()}
    for p, x, y in points[:-2]:
        d2, g = min(((x - a) ** 2 + (y - b) ** 2, n) for n, a, b in nodes[:-2])
        assert got[p] == (g, pytest.approx(d2))
    assert set(got) == {p for p, _, _ in points[:-2]}
    assert spatial.nearest_planar(df(points, "p"), df(nodes[:0], "g"), "p", "g", "x", "y").collect() == []


def chi2_reference(x, df):
    """The tail by sums of positive terms in forty digits: of a Poisson law for even df, from erfc on for odd."""
    from decimal import Decimal, getcontext

    getcontext().prec = 40
    z, total = Decimal(x) / 2, Decimal(0)
    if df % 2 == 0:
        term = (-z).exp()
        for k in range(df // 2):
            total += term
            term = term * z / (k + 1)
        return float(total)
    term = (-z).exp() * 2 * z.sqrt() / Decimal("3.141592653589793238462643383279502884197").sqrt()
    for k in range(1, (df + 1) // 2):
        total += term
        term = term * z / (k + Decimal("0.5"))
    return math.erfc(math.sqrt(x / 2)) + float(total)


def test_chi2_tail_for_all_sizes(spark):
    rows = [(float(x), d) for d in (1, 2, 3, 5, 9, 10, 19, 20, 21, 50, 99, 400, 401, 1000) for x in (0.01, 0.5, 1.0, d / 2, d - 0.5, d + 0.5, d + 1.0, d + 2.5, 1.3 * d, 2 * d + 10, 700.0)]
    rows += [(float(d + s * math.sqrt(2 * d)), d) for d in (10_000, 100_000, 1_000_000) for s in (-4, -1, 0, 0.5, 2, 6, 12)] + [(1000.0, 1000), (450.0, 500)]
    got = spark.createDataFrame(rows, "x double, df long").withColumn("p", statistics.chi2_tail(F.col("x"), F.col("df"))).collect()
    for r in got:
        want = chi2_reference(r.x, r.df)
        assert abs(r.p - want) <= 1e-8 * want + 1e-300, (r, want)


def test_rows_in_an_order_of_categories(spark):
    rows = spark.createDataFrame([("low", 2), ("high", 1), ("mid", 3), ("low", 1), ("high", 0)], "c string, v int").repartition(3)
    got = [tuple(r) for r in windows.ordered_by_category(rows, "c", ["high", "mid", "low"], [F.desc("v")]).collect()]
    assert got == [("high", 1), ("high", 0), ("mid", 3), ("low", 2), ("low", 1)]


def test_widened_is_one_aggregate(spark):
    from panelspark.queries import panel as rows_of_panel

    long = spark.createDataFrame([(1, "2", 0.5), (1, "3", None), (1, "2", 0.7), (2, "4", 0.1), (2, "9", 9.0), (None, "3", 0.2)], "k long, class string, score double")
    got = windows.widened(long, ["k"], "class", ["2", "3", "4"], "score").collect()
    assert {tuple(r) for r in got} == {(1, 0.7, None, None), (2, None, None, 0.1), (None, None, 0.2, None)}
    plan = rows_of_panel.wide_labels_flagged(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate")]
    assert above.count("Aggregate") == 1, above  # a pivot's first aggregate holds a row for each key and class


def test_lookups_work_out_the_panel_once(spark, monkeypatch):
    from panelspark.queries import joining

    plans, hold = [], asof.hold
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(asof, "hold", lambda df: plans.append(plan(df)) or hold(df))
    folder = "/root/testdata/sf0.001"
    plans += [plan(getattr(joining, name)(spark, folder)) for name in ("asof_fallback_persistence", "asof_own_history", "asof_12m_lag")]
    assert len(plans) > 6 and not any("l_extendedprice" in p for p in plans)
