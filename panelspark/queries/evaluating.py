"""Evaluation of predictions: metrics, confusion tables, frontiers, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as X
from ..operators import calibration, frontier, metrics
from ..sources import table
from .base import CUTOFF, PREDICTIONS, Registry, label_sql, predictions, r6

query = Registry()
_METRICS = ("accuracy", "mae", "r2_share", "r2_flags", "r2_flag_share", "precision", "recall", "f1", "f2")


def evaluation_sql(source: str, by: str) -> str:
    key, group = (f"{by}, ", f"GROUP BY {by}") if by else ("", "")
    r2 = lambda y, p: f"CASE WHEN count({y}) >= 2 AND max({y}) > min({y}) THEN 1 - sum(pow({y} - {p}, 2)) / (var_pop({y}) * count({y})) END"
    return f"""SELECT {key}n, round(accuracy, 6) AS accuracy, tp, fp, fn, tn, round(mae, 6) AS mae, round(r2_share, 6) AS r2_share, r2_reason, round(r2_flags, 6) AS r2_flags, round(r2_flag_share, 6) AS r2_flag_share,
  round(tp / nullif(tp + fp, 0), 6) AS "precision", round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1, round(5 * tp / nullif(5 * tp + 4 * fn + fp, 0), 6) AS f2,
  CASE WHEN tp + fp = 0 THEN 'no_predicted_positive' END AS precision_reason, CASE WHEN tp + fn = 0 THEN 'no_actual_positive' END AS recall_reason
FROM (SELECT {key}count(*) AS n, avg((actual = predicted)::INT) AS accuracy, count(*) FILTER (WHERE actual >= 3 AND predicted >= 3) AS tp, count(*) FILTER (WHERE actual < 3 AND predicted >= 3) AS fp,
  count(*) FILTER (WHERE actual >= 3 AND predicted < 3) AS fn, count(*) FILTER (WHERE actual < 3 AND predicted < 3) AS tn, avg(abs(actual - predicted)) AS mae,
  {r2("y", "p")} AS r2_share, CASE WHEN count(y) < 2 THEN 'insufficient_observations' WHEN max(y) = min(y) THEN 'constant_actual_share' END AS r2_reason,
  {r2("a", "b")} AS r2_flags, {r2("a", "p")} AS r2_flag_share
  FROM (SELECT *, (actual >= 3)::INT::DOUBLE AS a, (predicted >= 3)::INT::DOUBLE AS b FROM {source}) {group})"""


@query(f"WITH {PREDICTIONS}, t AS (SELECT * FROM predictions WHERE month >= DATE '{CUTOFF}'), pooled AS ({evaluation_sql('t', '')}), per AS ({evaluation_sql('t', 'grp')}) SELECT 'pooled' AS grp, * FROM pooled UNION ALL SELECT * FROM per")
def panel_evaluation(spark, d):
    """Persistence, evaluated on the test months by group and pooled, in one grouping-sets-like pass over both."""
    t = predictions(spark, d).filter(F.col("month") >= F.lit(CUTOFF).cast("date")).select("grp", "actual", "predicted", "y", "p")
    both = t.select(F.explode(F.array(F.lit("pooled"), F.col("grp"))).alias("grp"), "actual", "predicted", "y", "p")
    return r6(metrics.evaluate(both, ["grp"]), *_METRICS)


@query(f"WITH {PREDICTIONS}, e AS ({evaluation_sql('predictions', 'entity')}) SELECT entity, n, tp, fp, fn, tn, coalesce(\"precision\", 0) AS \"precision\", coalesce(recall, 0) AS recall, coalesce(f1, 0) AS f1, coalesce(f2, 0) AS f2 FROM e")
def binary_metrics_zero(spark, d):
    out = metrics.evaluate(predictions(spark, d), ["entity"], zero=True)
    return r6(out.select("entity", "n", "tp", "fp", "fn", "tn", "precision", "recall", "f1", "f2"), "precision", "recall", "f1", "f2")


_GRID = "grid AS (SELECT CAST(a AS INTEGER) AS actual, CAST(p AS INTEGER) AS predicted FROM range(1, 6) t(a), range(1, 6) u(p)), cells AS (SELECT g.actual, g.predicted, count(x.actual) AS n FROM grid g LEFT JOIN predictions x ON x.actual = g.actual AND x.predicted = g.predicted GROUP BY 1, 2)"


@query(f"WITH {PREDICTIONS}, {_GRID} SELECT *, CAST(sum(n) OVER (PARTITION BY actual) AS BIGINT) AS row_total, round(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 6) AS row_share FROM cells")
def confusion_5x5(spark, d):
    return r6(metrics.confusion(predictions(spark, d), []), "row_share")


@query(f"""WITH {PREDICTIONS}, c AS (SELECT grp, (actual >= 3)::INT AS actual, (predicted >= 3)::INT AS predicted FROM predictions), g AS (SELECT grp, a AS actual, p AS predicted FROM (SELECT DISTINCT grp FROM c), (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS p)),
n AS (SELECT g.grp, g.actual, g.predicted, count(c.grp) AS n FROM g LEFT JOIN c USING (grp, actual, predicted) GROUP BY ALL)
SELECT *, CAST(sum(n) OVER (PARTITION BY grp, actual) AS BIGINT) AS row_total, round(n / nullif(sum(n) OVER (PARTITION BY grp, actual), 0), 6) AS row_share FROM n""")
def confusion_2x2(spark, d):
    rows = predictions(spark, d).select("grp", (F.col("actual") >= 3).cast("int").alias("actual"), (F.col("predicted") >= 3).cast("int").alias("predicted"))
    return r6(metrics.confusion(rows, ["grp"], domain=(0, 1)), "row_share")


_CLASSES = f"""{PREDICTIONS}, {_GRID}, s AS (SELECT actual AS class, sum(CASE WHEN actual = predicted THEN n ELSE 0 END) AS tp, sum(n) AS support FROM cells GROUP BY 1),
q AS (SELECT predicted AS class, sum(n) AS predicted_support FROM cells GROUP BY 1),
k AS (SELECT class, CAST(tp AS BIGINT) AS tp, CAST(support AS BIGINT) AS support, CAST(predicted_support AS BIGINT) AS predicted_support, tp / nullif(predicted_support, 0) AS "precision", coalesce(tp / nullif(predicted_support, 0), 0) AS precision_zero,
  coalesce(tp / nullif(support, 0), 0) AS recall, coalesce(2 * tp / nullif(support + predicted_support, 0), 0) AS f1 FROM s JOIN q USING (class))"""


@query(f'WITH {_CLASSES} SELECT class, tp, support, predicted_support, round("precision", 6) AS "precision", round(precision_zero, 6) AS precision_zero, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM k')
def class_metrics(spark, d):
    return r6(metrics.class_metrics(metrics.confusion(predictions(spark, d), []), []), "precision", "precision_zero", "recall", "f1")


@query(f"""WITH {_CLASSES} SELECT round(avg(precision_zero) FILTER (WHERE support > 0), 6) AS macro_precision, round(avg(recall) FILTER (WHERE support > 0), 6) AS macro_recall, round(avg(f1) FILTER (WHERE support > 0), 6) AS macro_f1,
  round(avg(recall) FILTER (WHERE support > 0), 6) AS balanced_accuracy, round(avg(f1), 6) AS macro_f1_all, count(*) FILTER (WHERE support > 0) AS n_classes FROM k""")
def class_summary(spark, d):
    out = metrics.class_summary(metrics.class_metrics(metrics.confusion(predictions(spark, d), []), []), [])
    return r6(out, "macro_precision", "macro_recall", "macro_f1", "balanced_accuracy", "macro_f1_all")


@query(f"WITH {PREDICTIONS} SELECT grp, round(" + " + ".join(f"abs(avg((actual = {k})::INT) - avg((predicted = {k})::INT))" for k in range(1, 6)) + ", 6) AS distribution_gap FROM predictions GROUP BY grp")
def distribution_gap(spark, d):
    return r6(metrics.distribution_gap(predictions(spark, d), ["grp"]), "distribution_gap")


@query(f"WITH {PREDICTIONS} SELECT grp, round(regr_slope(y, p), 6) AS slope, round(regr_intercept(y, p), 6) AS intercept FROM predictions GROUP BY grp")
def line_fit(spark, d):
    return r6(metrics.line_fit(predictions(spark, d), ["grp"], "y", "p"), "slope", "intercept")


@query(f"WITH {PREDICTIONS}, {_GRID} SELECT actual AS before, predicted AS after, n, CAST(sum(n) OVER (PARTITION BY actual) AS BIGINT) AS row_total, round(n / nullif(sum(n) OVER (PARTITION BY actual), 0), 6) AS row_share, round(n / sum(n) OVER (), 6) AS share_of_all FROM cells")
def transition_matrix(spark, d):
    return r6(metrics.transitions(predictions(spark, d), "actual", "predicted"), "row_share", "share_of_all")


@query(f"WITH {PREDICTIONS} SELECT count(*) FILTER (WHERE predicted > actual) AS promotions, count(*) FILTER (WHERE predicted < actual) AS demotions, count(*) FILTER (WHERE predicted = actual) AS unchanged, round(avg((predicted > actual)::INT), 6) AS promoted_share, round(avg((predicted < actual)::INT), 6) AS demoted_share FROM predictions")
def change_counts(spark, d):
    return r6(metrics.change_counts(predictions(spark, d), "actual", "predicted"), "promoted_share", "demoted_share")


@query(f"WITH {PREDICTIONS}, e AS ({evaluation_sql('predictions', 'grp')}) SELECT grp, round(abs(accuracy + recall + \"precision\" + r2_share), 4) AS tuning_score FROM e")
def tuning_scores(spark, d):
    out = metrics.tuning_score(r6(metrics.evaluate(predictions(spark, d), ["grp"]), *_METRICS))
    return out.select("grp", X.round_away(F.col("tuning_score"), 4).alias("tuning_score"))


@query(f"WITH {PREDICTIONS} SELECT grp, round((count(*) FILTER (WHERE (actual >= 3) = (predicted >= 3))) / count(*), 6) AS accuracy FROM predictions GROUP BY grp")
def accuracy_from_rates(spark, d):
    """Put together from recall and precision, it is the binary accuracy that counting gives."""
    e = metrics.evaluate(predictions(spark, d), ["grp"], zero=True)
    got = metrics.accuracy_from_rates(F.col("recall"), F.col("precision"), F.col("tp") + F.col("fn"), F.col("n"))
    return r6(e.select("grp", got.alias("accuracy")), "accuracy")


@query(f"WITH {PREDICTIONS} SELECT grp, count(*) AS n, count(DISTINCT entity) AS n_entities, round(min(p), 6) AS min_p, round(max(p), 6) AS max_p, round(min(y), 6) AS min_y, round(max(y), 6) AS max_y FROM predictions GROUP BY grp")
def panel_summary(spark, d):
    return r6(metrics.panel_summary(predictions(spark, d), ["grp"], "entity", "p", "y"), "min_p", "max_p", "min_y", "max_y")


def _scored(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id").select(F.least(F.lit(1.0), X.round_away(F.col("n_chars") / 20000, 3)).alias("score"), F.col("quality").alias("target"), "doc_id")


_SCORED = "scored AS (SELECT least(1.0::DOUBLE, round(n_chars / 20000, 3)) AS score, quality AS target, doc_id FROM documents JOIN labels USING (doc_id))"
_FRONT = f"""{_SCORED}, per AS (SELECT score AS threshold, sum(target) AS pos, count(*) - sum(target) AS neg FROM scored GROUP BY 1), tot AS (SELECT sum(pos) AS positives, sum(neg) AS negatives, max(threshold) AS mx FROM per),
run AS (SELECT threshold, false AS nothing, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp FROM per UNION ALL SELECT mx, true, 0, 0 FROM tot),
front AS (SELECT threshold, nothing, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives, CAST(positives - tp AS BIGINT) AS fn, CAST(negatives - fp AS BIGINT) AS tn,
  tp / nullif(tp + fp, 0) AS "precision", tp / nullif(positives, 0) AS recall, 5 * tp / nullif(5 * tp + 4 * (positives - tp) + fp, 0) AS f2, 100.0 * fp / (positives + negatives) AS false_per_100 FROM run, tot)"""


@query(f'WITH {_FRONT} SELECT * REPLACE (round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f2, 6) AS f2, round(false_per_100, 6) AS false_per_100) FROM front')
def pr_frontier(spark, d):
    return r6(frontier.frontier(_scored(spark, d), [], "score", "target").drop("gained"), "precision", "recall", "f2", "false_per_100")


@query(f"""WITH {_FRONT}, g AS (SELECT *, tp - coalesce(lag(tp) OVER (ORDER BY threshold DESC), 0) AS gain FROM front WHERE NOT nothing)
SELECT round(sum(gain / positives * "precision"), 6) AS average_precision FROM g""")
def average_precision(spark, d):
    return r6(frontier.average_precision(frontier.frontier(_scored(spark, d), [], "score", "target"), []), "average_precision")


@query(f"""WITH {_FRONT} SELECT threshold, nothing, tp, fp, fn, tn, round("precision", 6) AS "precision", round(recall, 6) AS recall, round(f2, 6) AS f2, CASE WHEN tp > 0 THEN 'effective' ELSE 'no_effective_threshold' END AS outcome FROM front
ORDER BY coalesce(f2, -1) DESC, coalesce(recall, -1) DESC, coalesce("precision", -1) DESC, fp, tp + fp, front.threshold DESC, nothing LIMIT 1""")
def policy_select(spark, d):
    return r6(frontier.policy(frontier.frontier(_scored(spark, d), [], "score", "target"), []), "precision", "recall", "f2")


_CANDIDATES = """cand AS (SELECT 'coarse' AS candidate, round(n_chars / 20000, 1) AS score, quality AS target FROM documents JOIN labels USING (doc_id) UNION ALL
  SELECT 'fine', least(1.0::DOUBLE, round(n_chars / 20000, 3)), quality FROM documents JOIN labels USING (doc_id) UNION ALL
  SELECT 'same', 2 * least(1.0::DOUBLE, round(n_chars / 20000, 3)), quality FROM documents JOIN labels USING (doc_id) UNION ALL
  SELECT 'reversed', -n_chars::DOUBLE, quality FROM documents JOIN labels USING (doc_id)),
per AS (SELECT candidate, score AS threshold, sum(target) AS pos, count(*) - sum(target) AS neg FROM cand GROUP BY 1, 2), tot AS (SELECT candidate, sum(pos) AS positives, sum(neg) AS negatives, max(threshold) AS mx FROM per GROUP BY 1),
run AS (SELECT candidate, threshold, false AS nothing, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM per WINDOW w AS (PARTITION BY candidate ORDER BY threshold DESC) UNION ALL SELECT candidate, mx, true, 0, 0 FROM tot),
front AS (SELECT candidate, threshold, nothing, tp, fp, tp / nullif(tp + fp, 0) AS "precision", tp / nullif(positives, 0) AS recall, 5 * tp / nullif(5 * tp + 4 * (positives - tp) + fp, 0) AS f2 FROM run JOIN tot USING (candidate)),
best AS (SELECT *, list_position(['same', 'fine', 'coarse', 'reversed'], candidate) AS place FROM front QUALIFY row_number() OVER (PARTITION BY candidate ORDER BY coalesce(f2, 0) DESC, coalesce(recall, 0) DESC, coalesce("precision", 0) DESC, fp, tp + fp, threshold DESC, nothing) = 1)"""


@query(f"""WITH {_CANDIDATES} SELECT candidate, round(threshold, 6) AS threshold, nothing, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(f2, 6) AS f2, 'selected' AS status,
  row_number() OVER (ORDER BY coalesce(f2, 0) DESC, coalesce(recall, 0) DESC, coalesce("precision", 0) DESC, fp, tp + fp, place, threshold DESC) = 1 AS "primary" FROM best""")
def policies_in_order(spark, d):
    """Four candidates: two with the same frontier under different scores, so that their order decides, a coarser one and a reversed one."""
    rows = table(spark, d, "documents").select("doc_id", "n_chars").join(table(spark, d, "labels"), "doc_id")
    n = F.col("n_chars") / 20000
    fine = F.least(F.lit(1.0), X.round_away(n, 3))
    scores = F.array(*(F.struct(F.lit(c).alias("candidate"), s.alias("score")) for c, s in (("coarse", X.round_away(n, 1)), ("fine", fine), ("same", 2 * fine), ("reversed", -F.col("n_chars").cast("double")))))
    front = frontier.frontier(rows.select(F.inline(scores), F.col("quality").alias("target")), ["candidate"], "score", "target")
    out = frontier.ordered_policies(front, "candidate", ["same", "fine", "coarse", "reversed"])
    return r6(out.select("candidate", "threshold", "nothing", "tp", "fp", "f2", "status", "primary"), "threshold", "f2")


@query(f"WITH {_SCORED} SELECT round(-avg(target * ln(p) + (1 - target) * ln(1 - p)), 6) AS log_loss FROM (SELECT target, least(greatest(score, 1e-15), 1 - 1e-15) AS p FROM scored)")
def log_loss(spark, d):
    return r6(_scored(spark, d).agg(metrics.log_loss("target", "score").alias("log_loss")), "log_loss")


@query(f"WITH {PREDICTIONS}, t AS (SELECT CAST(year(month) AS INTEGER) AS year, p4 >= 0.15 AS hit, actual >= 4 AS y FROM predictions) SELECT year, count(*) AS n, count(*) FILTER (WHERE hit AND y) AS tp, count(*) FILTER (WHERE hit AND NOT y) AS fp, count(*) FILTER (WHERE NOT hit AND y) AS fn FROM t GROUP BY year UNION ALL SELECT -1, count(*), count(*) FILTER (WHERE hit AND y), count(*) FILTER (WHERE hit AND NOT y), count(*) FILTER (WHERE NOT hit AND y) FROM t")
def threshold_stability(spark, d):
    rows = predictions(spark, d).select("month", "p4", (F.col("actual") >= 4).cast("int").alias("t"))
    return frontier.stability(rows, F.year("month"), "p4", "t", 0.15).withColumn("year", F.coalesce("year", F.lit(-1)))


def _isotonic_sql(ys: list[str]) -> list[str]:
    mean = lambda j, k: "(" + " + ".join(ys[j : k + 1]) + f") / {k - j + 1}.0::DOUBLE"
    many = lambda f, xs: f"{f}({', '.join(xs)})" if len(xs) > 1 else xs[0]
    n = len(ys)
    return [f"least(greatest({many('least', [many('greatest', [mean(j, k) for k in range(i, n)]) for j in range(i + 1)])}, 0), 1)" for i in range(n)]


@query(f"WITH {PREDICTIONS}, s AS (SELECT entity, month, p2 - 0.1::DOUBLE AS y2, p3 + 0.05::DOUBLE AS y3, p4, p5 + 0.1::DOUBLE AS y5 FROM predictions) SELECT entity, month, " + ", ".join(f"round({e}, 6) AS f{k}" for k, e in zip(range(2, 6), _isotonic_sql(["y2", "y3", "p4", "y5"]), strict=True)) + " FROM s", dates=("month",))
def isotonic_project(spark, d):
    ys = [F.col("p2") - 0.1, F.col("p3") + 0.05, F.col("p4"), F.col("p5") + 0.1]
    fit = X.isotonic_decreasing(ys)
    return r6(predictions(spark, d).select("entity", "month", *(c.alias(f"f{k}") for k, c in zip(range(2, 6), fit, strict=True))), "f2", "f3", "f4", "f5")


_MOVED = _isotonic_sql(["p2", "(p3 + d3)", "(p4 + d4)", "(p5 + d4)"])
_OFFSETS = [-0.1, -0.05, 0.0, 0.05, 0.1]
_R = [f"sum(n) FILTER (WHERE a = {k} AND q = {k}) / nullif(sum(n) FILTER (WHERE a = {k}), 0)" for k in range(1, 6)]
_OFFSET_GRID = f"""{PREDICTIONS}, o AS (SELECT d3, d4 FROM (SELECT unnest({_OFFSETS}::DOUBLE[]) AS d3), (SELECT unnest({_OFFSETS}::DOUBLE[]) AS d4)),
mv AS (SELECT d3, d4, actual AS a, {", ".join(f"round_even(({e}) * 100, 0) / 100 AS m{k}" for k, e in zip(range(2, 6), _MOVED, strict=True))} FROM predictions, o),
cl AS (SELECT d3, d4, a, {label_sql("m")} AS q, count(*) AS n FROM mv GROUP BY ALL),
offs AS (SELECT d3, d4, sum(n * abs(a - q)) / sum(n) AS mae, coalesce({_R[3]}, CASE WHEN sum(n) FILTER (WHERE a = 4) > 0 THEN 0 END) AS recall4,
  ({" + ".join(f"coalesce({r}, 0)" for r in _R)}) / ({" + ".join(f"(coalesce(sum(n) FILTER (WHERE a = {k}), 0) > 0)::INT" for k in range(1, 6))}) AS balanced,
  coalesce(sum(n) FILTER (WHERE a >= 3 AND q >= 3), 0) / nullif(sum(n) FILTER (WHERE q >= 3), 0) AS "precision",
  coalesce(sum(n) FILTER (WHERE a >= 3 AND q >= 3), 0) / nullif(sum(n) FILTER (WHERE a >= 3), 0) AS recall FROM cl GROUP BY d3, d4)"""


def _offset_grid(spark, d):
    axis = F.array(*map(F.lit, _OFFSETS))
    offsets = spark.range(1).select(F.explode(axis).alias("d3")).select("d3", F.explode(axis).alias("d4"))
    return calibration.offset_grid(predictions(spark, d), offsets, {k: f"p{k}" for k in range(2, 6)}, "actual")


@query(f'WITH {_OFFSET_GRID} SELECT d3, d4, round(mae, 6) AS mae, round(recall4, 6) AS recall4, round(balanced, 6) AS balanced, round("precision", 6) AS "precision", round(recall, 6) AS recall FROM offs')
def offset_grid_search(spark, d):
    return r6(_offset_grid(spark, d), "mae", "recall4", "balanced", "precision", "recall")


@query(f"""WITH {_OFFSET_GRID}, b AS (SELECT * FROM offs WHERE d3 = 0 AND d4 = 0),
k AS (SELECT o.*, coalesce(o.mae < b.mae AND o.recall4 > b.recall4 AND o.balanced >= b.balanced AND o."precision" >= b."precision" - 0.02 AND o.recall >= b.recall - 0.02, false) AS ok FROM offs o, b)
SELECT d3, d4, round(mae, 6) AS mae, round(recall4, 6) AS recall4, round(balanced, 6) AS balanced, round("precision", 6) AS "precision", round(recall, 6) AS recall, CASE WHEN ok THEN 'accepted' ELSE 'identity' END AS status
FROM k WHERE ok OR (d3 = 0 AND d4 = 0) ORDER BY NOT ok, k.mae, -k.recall4, -k.balanced, abs(d3) + abs(d4), d3, d4 LIMIT 1""")
def offset_acceptance(spark, d):
    return r6(calibration.accept(_offset_grid(spark, d)), "mae", "recall4", "balanced", "precision", "recall")


@query(f"WITH {PREDICTIONS} SELECT entity, month, actual, predicted FROM predictions WHERE (actual >= 3) <> (predicted >= 3) AND month >= DATE '{CUTOFF}'", dates=("month",))
def disagreements(spark, d):
    rows = predictions(spark, d).filter(F.col("month") >= F.lit(CUTOFF).cast("date"))
    return rows.filter((F.col("actual") >= 3) != (F.col("predicted") >= 3)).select("entity", "month", "actual", "predicted")


QUERIES, ORACLE_SQL = query.queries, query.sql
