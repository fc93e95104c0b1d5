"""Models on the panel. Their rows have no SQL; tests check invariants."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import functions as X
from ..held import hold
from ..operators import metrics, splits
from ..plans import attribution, boosted, experiments, models, probit
from ..plans.experiments import Task
from ..plans.least_squares import Part
from .base import CUTOFF, Registry, groups, panel, r6

query = Registry()
TARGETS = ["c2", "c3", "c4", "c5"]
LAGGED = ["lag_c2", "lag_c3", "lag_c4", "lag_c5", "lat", "lon"]
CURRENT = ["month_number", "log_total", "lag_total"]
SMALL = {"general": {"maxIter": 4, "maxDepth": 3, "stepSize": 0.3, "maxBins": 16}, "upper": {"maxIter": 4, "maxDepth": 3, "stepSize": 0.2, "maxBins": 16}}


def frame(spark, d) -> DataFrame:
    """Panel rows with features of the month before (missing for an entity's first) and of the month itself."""
    before = Window.partitionBy("entity").orderBy("month")
    rows = panel(spark, d).filter("s1 IS NOT NULL").join(groups(spark, d), "entity")
    rows = rows.withColumns({**{f"lag_{t}": F.lag(t).over(before) for t in TARGETS}, "lag_total": F.ln(F.lag("total").over(before))})
    rows = rows.withColumns({"log_total": F.ln("total"), "month_number": F.month("month").cast("double"), "split": splits.temporal(F.col("month"), CUTOFF), "fold": splits.hashed_folds(["entity"], 3)})
    return hold(rows.select("entity", "month", "grp", "label", "split", "fold", *TARGETS, *LAGGED, *CURRENT))


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


def _evaluated(scored: DataFrame, name: str) -> DataFrame:
    hats = {k: X.round_even(F.col(f"hat_c{k}")) for k in range(2, 6)}
    rows = scored.select("label", "c3", *(c.alias(f"q{k}") for k, c in hats.items()))
    rows = rows.select(F.col("label").alias("actual"), X.majority_label({k: F.col(f"q{k}") for k in hats}).alias("predicted"), F.col("c3").alias("y"), F.col("q3").alias("p"))
    return metrics.evaluate(rows.withColumn("model", F.lit(name)), ["model"])


#: Parameters of the boosted trees that take missing values as they are: of the lowest class, and of those above.
GENERAL, UPPER = boosted.Params(rounds=200, depth=6, rate=0.1, bins=63), boosted.Params(rounds=200, depth=6, rate=0.05, bins=63)
#: The experiments fit hundreds of models each.
ROUNDS = 40


def _panel(rounds: int = GENERAL.rounds) -> experiments.Panel:
    return experiments.Panel(general=replace(GENERAL, rounds=rounds), upper=replace(UPPER, rounds=rounds))


def _boosted(rows: DataFrame, parts: list[Part], name: str) -> DataFrame:
    rows = hold(rows.withColumn("__id", F.monotonically_increasing_id()))
    scored = experiments.boosted_scores(rows, parts, _panel(), "__id").join(rows.select("__id", "label", "c3"), "__id")
    return metrics.evaluate(experiments.labelled(scored, _panel()).withColumn("model", F.lit(name)), ["model"])


@query()
def gbt_cumulative(spark, d):
    """200 trees of depth 6 for each of the four targets."""
    return _boosted(frame(spark, d), experiments.parts_of(Task(tuple(LAGGED))), "boosted")


@query()
def two_layer_residual(spark, d):
    return _boosted(frame(spark, d), experiments.parts_of(Task(tuple(LAGGED), tuple(CURRENT))), "two_layer")


@query()
def out_of_fold_scores(spark, d):
    """Each fold by the others; once as a rule, and once with the fold's number among the inputs, as it was published (which leaks)."""
    rows, every = frame(spark, d), (*LAGGED, *CURRENT)
    plain = _boosted(rows, experiments.parts_of(Task(every, (), "fold", (0, 1, 2))), "out_of_fold")
    return plain.unionByName(_boosted(rows, experiments.parts_of(Task((*every, "fold"), (), "fold", (0, 1, 2))), "fold_is_feature"))


@query()
def ols_ensemble(spark, d):
    train, test = _parts(frame(spark, d))
    return _evaluated(models.ols_ensemble(train, test, LAGGED + CURRENT, TARGETS), "ols")


@query()
def multinomial(spark, d):
    train, test = _parts(frame(spark, d))
    out = models.multinomial(train, test, LAGGED + CURRENT, "label")
    return r6(metrics.class_summary(metrics.class_metrics(metrics.confusion(out, [], "label", "predicted"), []), []), "macro_precision", "macro_recall", "macro_f1")


@query()
def ordered_probit(spark, d):
    train, test = _parts(frame(spark, d))
    fills = models.medians(train, LAGGED)
    tr, te = models.filled(train, fills, indicators=False)[0], models.filled(test, fills, indicators=False)[0]
    te, keep = models.standardised(te, tr, LAGGED)
    tr, _ = models.standardised(tr, tr, LAGGED)
    cuts, beta = probit.fit(tr, keep, "label", 5)
    return metrics.confusion(probit.predict(te, keep, cuts, beta), [], "label", "predicted")


#: Weightings of positives, by name.
WEIGHTINGS = {name: ({"maxIter": 4, "maxDepth": 3, "maxBins": 16}, power) for name, power in (("none", 0.0), ("root", 0.5), ("full", 1.0))}


def _promoted(scored: DataFrame) -> DataFrame:
    """A row (weights, actual, promoted) for each row and weighting."""
    cells = F.array(*(F.struct(F.lit(name).alias("weights"), F.col("label").alias("actual"), X.gated_promotion(F.lit(3), F.col(name), 0.5).alias("promoted")) for name in WEIGHTINGS))
    return scored.select(F.inline(cells))


@query()
def severe_classifier(spark, d):
    """Classes 4 and 5 against 3, with three weightings of positives, as a gate on predicted class 3."""
    train, test = _parts(frame(spark, d).filter("label >= 3").withColumn("severe", (F.col("label") >= 4).cast("int")))
    return _promoted(models.classify_many(train, test, LAGGED, "severe", WEIGHTINGS)).groupBy("weights", "actual", "promoted").agg(F.count("*").alias("n"))


@query()
def severe_classifier_residual(spark, d):
    """The same with a second layer on the month's own features, and out of fold, each with three weightings."""
    rows = frame(spark, d).filter("label >= 3").withColumn("severe", (F.col("label") >= 4).cast("int"))
    train, test = _parts(rows)
    forms = {"residual": models.classify_residual_many(train, test, LAGGED, CURRENT, "severe", WEIGHTINGS), "out_of_fold": models.out_of_fold_classify_many(rows, "fold", range(3), LAGGED + CURRENT, "severe", WEIGHTINGS)}
    out = reduce(DataFrame.unionByName, (_promoted(scored).select(F.lit(form).alias("form"), "*") for form, scored in forms.items()))
    return out.groupBy("form", "weights", "actual", "promoted").agg(F.count("*").alias("n"))


#: Parameters of the candidates, and the order in which they decide between equal ones.
CANDIDATES = {"depth": [1, 2, 3], "least_weight": [5.0, 20.0], "l2": [1.0, 10.0], "rate": [0.03, 0.1]}


@query()
def classifier_grid(spark, d):
    """24 candidates of 200 trees each, as published, on three forward folds. Trees see all rows, where the published ones drew four fifths."""
    rows = frame(spark, d).filter("label >= 3").withColumns({"severe": (F.col("label") >= 4).cast("int"), "year": F.year("month")})
    folds = [(F.col("year") <= y, F.col("year") == y + 1) for y in (1996, 1997, 1998)]
    return models.select_boosted(rows, folds, LAGGED, "severe", CANDIDATES, descending=("least_weight", "l2"))


@query()
def ols_residual_layer(spark, d):
    train, test = _parts(frame(spark, d))
    return _evaluated(models.ols_two_layer(train, test, LAGGED, CURRENT, TARGETS), "ols_two_layer")


@query()
def tree_shap(spark, d):
    """Sums of attributions by label, and the largest gap between base value plus attributions and the model's own score."""
    train, _ = _parts(frame(spark, d))
    tr, inputs = models.filled(train, models.medians(train, LAGGED))
    model = models.gbt(SMALL["upper"], "c3").fit(models.vector(tr, inputs).cache())
    scored = model.transform(models.vector(tr, inputs)).drop("features")
    out, base = attribution.tree_shap(scored, model, inputs)
    gap = F.abs(F.lit(base) + F.aggregate("shap", F.lit(0.0), lambda a, v: a + v) - F.col("__p"))
    return out.groupBy("label").agg(F.count("*").alias("n"), F.max(gap).alias("max_gap"), *(F.sum(F.col("shap")[k]).alias(f"shap_{c}") for k, c in enumerate(inputs)))


@query()
def perturbed_scores(spark, d):
    """The same trees on features times 1.1: promotions and demotions of the label."""
    train, test = _parts(frame(spark, d))
    fills = models.medians(train, LAGGED)
    base, fitted = models.cumulative_boosted(train, test, LAGGED, TARGETS, fills, **SMALL)
    moved, inputs = models.filled(X.scale_columns(test, "^lag_c", 1.1), fills)
    hats = lambda df, name: df.select("entity", "month", X.majority_label({k: X.round_even(F.col(f"hat_c{k}")) for k in range(2, 6)}).alias(name))
    both = hats(base, "before").join(hats(models.score(models.vector(moved, inputs), fitted), "after"), ["entity", "month"])
    return metrics.change_counts(both, "before", "after")


def _tasks() -> dict[str, Task]:
    return {"forecasting": Task(tuple(LAGGED)), "nowcasting": Task(tuple(LAGGED), tuple(CURRENT)), "contemporaneous": Task((*LAGGED, *CURRENT), (), "fold", (0, 1, 2))}


@query()
def spatial_conditions(spark, d):
    """Models with coordinates, without, and with means of neighbours: the five nearest, and those within 500 km; one layer and two."""
    from ..operators import spatial

    rows = frame(spark, d)
    places = hold(rows.select("entity", "lat", "lon").distinct())
    edges = {"knn5": hold(spatial.nearest(places, "entity", "lat", "lon", 5)), "km500": hold(spatial.within(places, places, "entity", "lat", "lon", 500.0))}
    tasks = {k: t for k, t in _tasks().items() if t.fold is None}
    return experiments.spatial(rows, edges, tasks, _panel(ROUNDS))


@query()
def missingness_experiment(spark, d):
    """Features or groups that miss most are removed: three thresholds by two removals by three tasks by three models."""
    return experiments.missingness(frame(spark, d), _tasks(), _panel(ROUNDS))


@query()
def missingness_without_indicators(spark, d):
    """The same without indicators of what was missing; of the models that have these as a choice."""
    return experiments.missingness(frame(spark, d), _tasks(), _panel(), kinds=("ols", "probit"), indicators=False)


@query()
def leave_group_out(spark, d):
    """Each group by models of the others, over all times and strictly in time: by least squares in one layer and two, and by boosted trees."""
    rows, out = frame(spark, d), []
    for task, model in (("forecasting", "ols"), ("nowcasting", "ols"), ("forecasting", "boosted")):
        for cutoff in (None, CUTOFF):
            out.append(experiments.groups_out(rows, _tasks()[task], _panel(ROUNDS), model, cutoff).withColumn("task", F.lit(task)))
    return reduce(DataFrame.unionByName, out)


QUERIES, ORACLE_SQL = query.queries, query.sql
