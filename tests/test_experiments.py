"""Models against NumPy on small frames, quantiles, and the experiments' runners."""

import random

import numpy as np
import pytest
from panelspark.operators import bootstrap, calibration, frontier, ranges
from panelspark.plans import boosted, experiments, least_squares, models, probit
from panelspark.sources.publish import CheckpointStore
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def frame(spark):
    rnd = np.random.RandomState(3)
    rows = []
    for k in range(240):
        a, b, c = rnd.normal(), rnd.normal(), rnd.normal()
        c3 = 0.4 + 0.2 * a - 0.1 * b + 0.05 * c + 0.02 * rnd.normal()
        share = {"c2": min(1.0, max(0.0, c3 + 0.2)), "c3": min(1.0, max(0.0, c3)), "c4": min(1.0, max(0.0, c3 - 0.2)), "c5": min(1.0, max(0.0, c3 - 0.4))}
        label = 1 + sum(v >= 0.2 for v in share.values())
        rows.append((k, k % 12, "ghij"[k % 4], label, *map(float, share.values()), float(a), None if k % 7 == 0 else float(b), float(c), 2 * float(c), "train" if k % 5 else "test", k % 3))
    return spark.createDataFrame(rows, "entity long, month int, grp string, label int, c2 double, c3 double, c4 double, c5 double, a double, b double, c double, twice double, split string, fold int").cache()


def design(rows, cols, fills):
    """Filled columns and what was missing, without columns that have no spread or are multiples of earlier ones."""
    x = [[fills[c] if r[c] is None else r[c] for c in cols] + [float(r[c] is None) for c in cols] for r in rows]
    return np.array(x)


def least_squares_of(train, test, cols, y):
    fills = {c: float(np.median([r[c] for r in train if r[c] is not None])) for c in cols}
    one = lambda x: np.column_stack([np.ones(len(x)), x])
    w = np.linalg.lstsq(one(design(train, cols, fills)), np.array(y), rcond=None)[0]
    return one(design(test, cols, fills)) @ w


def test_least_squares_in_one_layer_and_two(frame):
    train, test = frame.filter("split = 'train'"), frame.filter("split = 'test'")
    tr, te = train.orderBy("entity").collect(), test.orderBy("entity").collect()
    got = models.ols_ensemble(train, test, ["a", "b", "c", "twice"], ["c3"]).orderBy("entity").collect()
    want = least_squares_of(tr, te, ["a", "b", "c", "twice"], [r.c3 for r in tr])
    assert np.allclose([r.hat_c3 for r in got], want, atol=1e-6)
    two = models.ols_two_layer(train, test, ["a", "b"], ["c"], ["c3"])
    assert two.columns == [*test.columns, "hat_c3"]
    rest = np.array([r.c3 for r in tr]) - least_squares_of(tr, tr, ["a", "b"], [r.c3 for r in tr])
    want = least_squares_of(tr, te, ["a", "b"], [r.c3 for r in tr]) + least_squares_of(tr, te, ["c"], rest)
    assert np.allclose([r.hat_c3 for r in two.orderBy("entity").collect()], want, atol=1e-6)


def test_gram_matrix_and_independent_columns(frame):
    x = np.array([[r.a, r.c, r.twice] for r in frame.select("a", "c", "twice").collect()])
    assert np.allclose(models.gram_matrix(frame, ["a", "c", "twice"]), x.T @ x / len(x))
    assert models.independent(frame, ["a", "c", "twice"]) == ["a", "c"]
    wide = frame.select("entity", *(F.sin(F.col("a") * k + F.col("c") * (200 - k)).alias(f"x{k}") for k in range(200)))
    assert models.gram_matrix(wide, [f"x{k}" for k in range(200)]).shape == (200, 200)


def test_medians_both_ways(frame, monkeypatch):
    want = {c: float(np.median([r[c] for r in frame.collect() if r[c] is not None])) for c in "abc"}
    none = frame.withColumn("empty", F.lit(None).cast("double"))
    assert models.medians(none, ["a", "b", "c", "empty"]) == pytest.approx(want | {"empty": 0.0})
    monkeypatch.setattr(models, "FEW", 10)
    assert models.medians(none, ["a", "b", "c", "empty"]) == pytest.approx(want | {"empty": 0.0})


def test_medians_of_models_order_few_values(frame, monkeypatch):
    want = models.medians(frame, ["a", "b", "c"])
    monkeypatch.setattr(models, "FEW", 10)
    monkeypatch.setattr(least_squares, "quantiles", lambda *a: pytest.fail("all values are ordered"))
    monkeypatch.setattr(models, "quantiles", least_squares.quantiles, raising=False)
    assert models.medians(frame, ["a", "b", "c"]) == want


def test_quantiles_against_numpy(spark):
    rnd = random.Random(2)
    values = {"many": [rnd.gauss(0, 1) for _ in range(3000)], "ties": [float(rnd.randrange(3)) for _ in range(500)], None: [1.0, 5.0], "one": [7.0], "none": [None, float("nan")]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double")
    qs = {"q0": 0.0, "low": 0.025, "mid": 0.5, "q7": 0.7, "q1": 1.0}
    got = {r.g: r for r in ranges.quantiles(df, ["g"], "v", qs).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        for n, q in qs.items():
            assert got[g][n] is None if g == "none" else got[g][n] == pytest.approx(np.quantile(vs, q)), (g, n)
    whole = [v for g, vs in values.items() if g != "none" for v in vs]
    assert ranges.quantiles(df, [], "v", {"mid": 0.5}).first().mid == pytest.approx(np.median(whole))
    assert ranges.quantiles(df.limit(0), [], "v", {"mid": 0.5}).collect() == [(None,)] and ranges.quantiles(df.limit(0), ["g"], "v", {"mid": 0.5}).collect() == []


def test_frontier_with_crowded_scores(spark):
    rnd = random.Random(3)
    rows = [(0.5 + rnd.random() * 1e-7, rnd.randrange(2)) for _ in range(400)] + [(rnd.randrange(5) / 4, rnd.randrange(2)) for _ in range(200)]
    got = {r.threshold: r for r in frontier.frontier(spark.createDataFrame(rows, "s double, t int"), [], "s", "t").filter("NOT nothing").collect()}
    assert len(got) == len({s for s, _ in rows})
    for s, r in got.items():
        assert (r.tp, r.fp, r.gained) == (sum(t for x, t in rows if x >= s), sum(1 - t for x, t in rows if x >= s), sum(t for x, t in rows if x == s))


def test_folds_by_value_and_classifiers(frame):
    marked = frame.withColumn("severe", (F.col("c3") > 0.4).cast("int")).withColumn("f", F.when(F.col("fold") == 0, "x").when(F.col("fold") == 1, "y").otherwise("z"))
    params = {"maxIter": 2, "maxDepth": 2, "maxBins": 16}
    out = models.out_of_fold_classify(marked, "f", ["x", "y", "z"], ["a", "b"], "severe", params)
    assert sorted(r.entity for r in out.collect()) == list(range(240))
    two = models.classify_residual(marked.filter("fold > 0"), marked.filter("fold = 0"), ["a"], ["b", "c"], "severe", params)
    hit = [(r.score >= 0.5) == bool(r.severe) for r in two.collect()]
    assert sum(hit) / len(hit) > 0.8 and two.columns == [*marked.columns, "score"]
    ranked = models.select_classifier(marked, [(F.col("fold") < 2, F.col("fold") == 2)], ["a"], "severe", {"maxDepth": [1, 2], "maxIter": [1], "power": [0.0, 1.0]}).collect()
    assert sorted(r["rank"] for r in ranked) == [1, 2, 3, 4] and {(r.maxDepth, r.power) for r in ranked} == {(1, 0.0), (1, 1.0), (2, 0.0), (2, 1.0)}


TREES = boosted.Params(rounds=3, depth=2, rate=0.3, bins=31)


def test_experiments(frame, spark, tmp_path):
    tasks = {"first": experiments.Task(("a", "b")), "folds": experiments.Task(("a", "b", "c"), (), "fold", (0, 1, 2))}
    panel = experiments.Panel(general=TREES, upper=TREES)
    out = experiments.missingness(frame, tasks, panel, thresholds=(0, 30)).collect()
    assert len(out) == 2 * 2 * 2 * 3 and {r.reason for r in out if r.status != "ok"} <= {"ordered probit did not converge"}
    assert all(r.status == "ok" for r in out if r.model != "probit") and any(r.status == "ok" for r in out if r.model == "probit")
    at = {(r.removal, r.percent, r.task, r.model): r for r in out}
    assert at["group", "0", "first", "ols"].accuracy == at["feature", "0", "first", "ols"].accuracy and at["group", "0", "first", "ols"].delta_accuracy == 0
    assert at["feature", "30", "first", "ols"].accuracy < at["feature", "0", "first", "ols"].accuracy or at["feature", "30", "first", "ols"].n == 48
    assert at["feature", "0", "folds", "ols"].n == 240 and at["group", "30", "folds", "ols"].n == 120 and at["feature", "0", "folds", "boosted"].n == 240
    for model in ("ols", "boosted"):
        held = experiments.groups_out(frame, tasks["first"], panel, model).collect()
        assert sorted((r.held, r.n) for r in held) == [("g", 60), ("h", 60), ("i", 60), ("j", 60)]
    bad = experiments.missingness(frame, {"t": experiments.Task(("a",))}, panel, thresholds=(100,), kinds=("ols", "boosted")).collect()
    assert len(bad) == 4 and {r.status for r in bad} == {"not_estimable"} and {r.reason for r in bad if r.removal == "feature"} == {"no feature is left"}


def test_a_store_serves_only_the_same_experiment(frame, spark, tmp_path):
    store, panel = CheckpointStore(spark, f"file://{tmp_path}/cells"), experiments.Panel(general=TREES, upper=TREES)
    task, fitted = experiments.Task(("a", "b")), []
    real = experiments._together

    def counted(*args):
        fitted.append(args[1])
        return real(*args)

    run = lambda rows, task, panel=panel, **how: experiments.missingness(rows, {"t": task}, panel, thresholds=(0,), kinds=("ols",), store=store, **how).first()
    try:
        experiments._together = counted
        first, again = run(frame, task), run(frame, task)
        assert first == again and len(fitted) == 1
        other = run(frame, experiments.Task(("b",)))
        assert len(fitted) == 2 and other.accuracy == experiments.missingness(frame, {"t": experiments.Task(("b",))}, panel, thresholds=(0,), kinds=("ols",)).first().accuracy
        for rows, how in ((frame, {"indicators": False}), (frame.filter("entity <> 7"), {}), (frame, {"panel": experiments.Panel(general=TREES, upper=TREES, targets=("c2", "c3"))})):
            n = len(fitted)
            run(rows, task, **how)
            assert len(fitted) == n + 1
    finally:
        experiments._together = real


def test_null_groups_and_failures(frame, spark):
    """A null group is a group: it isn't lost when others go, and is held out like any other; cells that can't be fitted are a status."""
    panel, task = experiments.Panel(general=TREES, upper=TREES), experiments.Task(("a", "b"))
    some = frame.withColumn("grp", F.when(F.col("grp") != "j", F.col("grp"))).withColumn("b", F.when(F.col("grp") == "g", None).otherwise(F.col("b")))
    out = {(r.removal, r.percent): r.n for r in experiments.missingness(some, {"t": experiments.Task(("a", "b"), (), "fold", (0, 1, 2))}, panel, thresholds=(0, 25), kinds=("ols",)).collect()}
    assert out["feature", "0"] == 240 and out["group", "25"] == 180
    for model in ("ols", "boosted"):
        held = {r.held: r for r in experiments.groups_out(some, task, panel, model).collect()}
        assert {k: r.n for k, r in held.items()} == {"g": 60, "h": 60, "i": 60, "None": 60}
        one = experiments.groups_out(some.filter("grp = 'g'"), task, panel, model).first()
        assert one.status == "not_estimable" and "no training rows" in one.reason


def test_held_out_groups_equal_single_fits(frame):
    """Least squares by taking sums away, in one layer and two, against fits of each group on its own."""
    rows = frame.withColumn("__id", F.col("entity"))
    groups = "ghij"
    parts = [least_squares.Part(f"{g}{n}", F.col("grp") != g, F.col("grp") == g, ("a", "b"), second) for g in groups for n, second in ((1, ()), (2, ("c", "b")))]
    hats, reasons = least_squares.fit_score(rows, parts, ["c3", "c4"], "__id")
    got = {(r.part, r["__id"]): (r.hat_c3, r.hat_c4) for r in hats.collect()}
    assert not reasons and len(got) == 2 * 240
    for g in groups:
        tr, te = (rows.filter(F.col("grp") != g).orderBy("entity").collect(), rows.filter(F.col("grp") == g).orderBy("entity").collect())
        for k, y in enumerate(("c3", "c4")):
            true = np.array([r[y] for r in tr])
            one = least_squares_of(tr, te, ["a", "b"], true)
            assert np.allclose([got[f"{g}1", r.entity][k] for r in te], one, atol=1e-8)
            rest = true - least_squares_of(tr, tr, ["a", "b"], true)
            assert np.allclose([got[f"{g}2", r.entity][k] for r in te], one + least_squares_of(tr, te, ["c", "b"], rest), atol=1e-8)


@pytest.mark.parametrize("found", ["in the bracket", "outside of it"])
def test_medians_of_many_rows_order_few_values(spark, monkeypatch, found):
    """Of more than FEW rows only the values near a median are shuffled; one outside its bracket is still exact."""
    rnd = np.random.RandomState(5)
    values = {"many": rnd.normal(size=3000), "ties": rnd.randint(0, 3, 3000) * 1.0, "zeros": np.where(rnd.rand(3000) < 0.7, -0.0, 0.0), "some": np.where(rnd.rand(3000) < 0.9, np.nan, rnd.normal(size=3000)), "none": np.full(3000, np.nan)}
    group, y = rnd.randint(0, 3, 3000), rnd.rand(3000)
    rows = spark.createDataFrame([(int(g), float(t), *(None if np.isnan(v) else float(v) for v in own)) for g, t, *own in zip(group, y, *values.values(), strict=True)], "g int, y double, " + ", ".join(f"{c} double" for c in values))
    parts = [least_squares.Part(str(k), F.col("g") != k, F.lit(False), tuple(values)) for k in range(3)] + [least_squares.Part("nothing", F.lit(False), F.lit(False), tuple(values)), least_squares.Part("one", (F.col("g") == 0) & (F.col("y") == float(y[group == 0][0])), F.lit(False), tuple(values))]
    base = least_squares.base_rows(rows, parts, list(values), ["y"], None).repartition(3).cache()
    few = least_squares.sums_of(base, parts, list(values), 1)
    monkeypatch.setattr(least_squares, "FEW", 10)
    asked, quantiles = [], least_squares.quantiles
    monkeypatch.setattr(least_squares, "quantiles", lambda *a: asked.append(1) or quantiles(*a))
    if found == "outside of it":
        brackets = least_squares._brackets
        monkeypatch.setattr(least_squares, "_brackets", lambda *a: brackets(*a) + 0.75)
    many = least_squares.sums_of(base, parts, list(values), 1)
    assert bool(asked) == (found == "outside of it")
    on = [group != k for k in range(3)] + [group < 0, np.arange(3000) == np.flatnonzero(group == 0)[0]]
    for k, own in enumerate(on):
        for j, v in enumerate(values.values()):
            x = v[own & ~np.isnan(v)]
            assert many.medians[k, j] == few.medians[k, j] == (np.median(x) if len(x) else 0), (k, j)
    assert set(many.by_pattern) == set(few.by_pattern) and all(np.allclose(many.of(k)[0, 0], few.of(k)[0, 0]) for k in (0, 1, 2, 4))


def test_two_layers_of_many_rows(frame, monkeypatch):
    train, test = frame.filter("split = 'train'"), frame.filter("split = 'test'")
    hats = lambda: [r.hat_c3 for r in models.ols_two_layer(train, test, ["a", "b"], ["c"], ["c3"]).orderBy("entity").collect()]
    want = hats()
    monkeypatch.setattr(least_squares, "FEW", 10)
    assert np.allclose(hats(), want, atol=1e-12)


@pytest.mark.parametrize("parts", [2, 3, 8, 9, 256])
def test_places_among_edges(spark, parts):
    rnd = np.random.RandomState(parts)
    edges = sorted(map(float, rnd.randint(0, 40, parts - 1)))
    values = [float("-inf"), *np.arange(-1, 42, 0.5).tolist(), float("inf")]
    rows = spark.createDataFrame([(edges, v) for v in values] + [([edges[0]] * 2, edges[0])][: parts > 2], "edges array<double>, v double").select(ranges._less("edges", "v", parts).alias("k"), "edges", "v")
    assert all(r.k == np.searchsorted(r.edges, r.v, "left") for r in rows.collect())


def test_boosted_layers_equal_single_fits(frame):
    panel = experiments.Panel(general=TREES, upper=TREES, targets=("c2", "c3"))
    rows = frame.withColumn("__id", F.col("entity"))
    parts = [least_squares.Part(g, F.col("grp") != g, F.col("grp") == g, ("a", "b"), second) for g, second in (("g", ("c",)), ("h", ()))]
    got = {(r.part, r["__id"]): (r.hat_c2, r.hat_c3) for r in experiments.boosted_scores(rows, parts, panel, "__id").collect()}
    assert len(got) == 120
    array = lambda some, cols: np.array([[np.nan if r[c] is None else r[c] for c in cols] for r in some])
    for g, second in (("g", True), ("h", False)):
        tr, te = ([r for r in rows.orderBy("entity").collect() if (r.grp == g) == test] for test in (False, True))
        for k, t in enumerate(("c2", "c3")):
            y = np.array([r[t] for r in tr])
            one = boosted.fit(array(tr, "ab"), y, np.ones(len(y)), TREES)
            want = boosted.predict(array(te, "ab"), one, TREES)
            if second:
                rest = y - boosted.predict(array(tr, "ab"), one, TREES)
                want = want + boosted.predict(array(te, "c"), boosted.fit(array(tr, "c"), rest, np.ones(len(y)), TREES), TREES)
            assert np.allclose([got[g, r.entity][k] for r in te], want, atol=1e-9)


def test_all_candidates_are_ranked(spark):
    rows = [(0.0, 0.0, 0.5, 0.2, 0.4, 0.8, 0.8), (0.1, 0.0, 0.4, 0.3, 0.5, 0.8, 0.8), (0.0, 0.1, 0.3, 0.3, 0.5, 0.8, 0.7), (0.2, 0.0, 0.45, 0.3, 0.5, 0.79, 0.8)]
    grid = spark.createDataFrame(rows, "d3 double, d4 double, mae double, recall4 double, balanced double, precision double, recall double")
    got = {(r.d3, r.d4): (r["rank"], r.ok) for r in calibration.ranked(grid).collect()}
    assert got == {(0.1, 0.0): (1, True), (0.2, 0.0): (2, True), (0.0, 0.1): (3, False), (0.0, 0.0): (4, False)}
    assert calibration.accept(grid).first().d3 == 0.1


def test_draws_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "BLOCK", 7)
    clusters = spark.range(40).selectExpr("cast(id as string) c").unionByName(spark.range(3).selectExpr("cast(id as string) c"))
    one, two = (bootstrap.draws(spark, clusters, "c", 30).collect() for _ in range(2))
    assert sorted(one) == sorted(two)
    totals = {}
    for r in one:
        totals[r.draw] = totals.get(r.draw, 0) + r.times
    assert totals == {d: 40 for d in range(30)} and {r.c for r in one} == {str(k) for k in range(40)}
    assert bootstrap.draws(spark, clusters.limit(0), "c", 3).collect() == []
    assert sorted(r.k for r in ranges.numbered(clusters.distinct(), "c", "k").collect()) == list(range(40))


def test_policies_in_an_order(spark):
    rows = [(c, s, t) for c in ("x", "y") for s, t in ((0.9, 1), (0.8, 0), (0.7, 1), (0.1, 0))] + [("z", 0.5, 0), ("z", 0.4, 1), ("w", 0.5, 1)]
    front = frontier.frontier(spark.createDataFrame(rows, "c string, s double, t int"), ["c"], "s", "t")
    for order, primary in ((["x", "y", "z"], "x"), (["z", "y", "x"], "y")):
        got = {r.c: r for r in frontier.ordered_policies(front, "c", order).collect()}
        assert set(got) == {"x", "y", "z"} and {c for c, r in got.items() if r.primary} == {primary} and {r.status for r in got.values()} == {"selected"}
        assert (got["x"].threshold, got["y"].threshold, got["z"].threshold) == (0.7, 0.7, 0.4)
    none = spark.createDataFrame([(c, s, 0) for c in "xy" for s in (0.2, 0.9)], "c string, s double, t int")
    got = frontier.ordered_policies(frontier.frontier(none, ["c"], "s", "t"), "c", ["x", "y"]).collect()
    assert [(r.status, r.primary, r.nothing, r.threshold) for r in got] == [("no_effective_rescue", False, True, 0.9)] * 2
    assert frontier.ordered_policies(front, "c", ["other"]).collect() == []


def test_many_probits_equal_single_fits(frame):
    rows = frame.withColumn("__id", F.col("entity"))
    parts = [least_squares.Part(g, F.col("grp") != g, F.col("grp") == g, cols) for g, cols in (("g", ("a", "b")), ("h", ("a", "b", "c", "twice")), ("i", ("a",)))]
    parts.append(least_squares.Part("none", F.lit(False), F.lit(True), ("a",)))
    got, reasons, fitted = probit.fit_score_many(rows, parts, "label", 5, "__id")
    assert reasons == {"none": "no training rows"}
    got = {(r.part, r["__id"]): r.predicted for r in got.collect()}
    for p in parts[:3]:
        train, test = rows.filter(p.train), rows.filter(p.test)
        fills = models.medians(train, list(p.cols))
        (tr, inputs), (te, _) = models.filled(train, fills), models.filled(test, fills)
        te, keep = models.standardised(te, tr, inputs)
        tr, _ = models.standardised(tr, tr, inputs)
        keep = models.independent(tr, keep)
        cuts, beta = probit.fit(tr, keep, "label", 5)
        assert np.allclose(fitted[p.name][0], cuts, atol=1e-6) and np.allclose(fitted[p.name][1], beta, atol=1e-6)
        assert {r.entity: r.predicted for r in probit.predict(te, keep, cuts, beta).collect()} == {i: v for (n, i), v in got.items() if n == p.name}


def test_candidates_share_what_a_fold_needs(spark, monkeypatch):
    """Medians once for each training set, fewer rounds as the first trees of more, and the scores of single fits."""
    rows = spark.range(400).selectExpr("id", "IF(id % 7 = 0, NULL, id % 13) * 1.0 AS a", "id % 5 * 1.0 AS b", "CAST((id * 7919 % 101) % 3 = 0 OR id % 13 > 8 AS INT) AS severe", "id % 3 AS fold")
    train, test = rows.filter("fold > 0"), rows.filter("fold = 0")
    settings = {f"r{n}_{p}": ({"maxIter": n, "maxDepth": 2}, p) for n in (1, 2, 3) for p in (0.0, 1.0)}
    asked, medians = [], models.medians
    monkeypatch.setattr(models, "medians", lambda train, cols: asked.append(1) or medians(train, cols))
    many = {r.id: r for r in models.classify_many(train, test, ["a", "b"], "severe", settings).collect()}
    assert len(asked) == 1
    for name in ("r1_0.0", "r2_1.0", "r3_1.0"):
        params, power = settings[name]
        one = {r.id: r.score for r in models.classify(train, test, ["a", "b"], "severe", params, power).collect()}
        assert one.keys() == many.keys() and all(abs(one[k] - many[k][name]) < 1e-12 for k in one)
    asked.clear()
    folds = [(F.col("fold") < 2, F.col("fold") == 2), (F.col("fold") > 0, F.col("fold") == 0)]
    ranked = models.select_classifier(rows, folds, ["a", "b"], "severe", {"maxDepth": [1, 2], "maxIter": [1, 2], "power": [0.0, 1.0]}).collect()
    assert len(asked) == len(folds) and len(ranked) == 8 and all(0 < r.average_precision <= 1 and r.log_loss > 0 for r in ranked)
