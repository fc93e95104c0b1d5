"""Every query with SQL gives the rows that DuckDB gives, at the smallest size; one session, a sample of the cheap ones is enough for each module."""

import glob
import os

import __spark_entry__ as entry
import duckdb
import pytest
from panelspark import queries as core

SF = "/root/testdata/sf0.001"
NAMES = ["panel_shares", "wide_labels_flagged", "strict_group_holdout", "nullsafe_compare", "asof_own_history", "knn5_neighbors", "two_level_population", "hamilton_quotas", "panel_evaluation", "class_metrics", "pr_frontier", "offset_acceptance", "cluster_bootstrap_ci", "bh_adjust", "holm_adjust", "chi2_cramers_v", "asof_fallback_persistence", "slot_imputation", "nearest_grid_point", "quantile_bounds", "group_spread", "q70_alert_flags", "average_precision", "csv_round_trip", "published_tables", "recomputed", "contracts_hold", "csv_provenance", "csv_places", "entity_folds", "seeded_sample", "archived"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from read_parquet('{f}')")
    return con


def _rows(rows, names, want):
    order = [names.index(n) for n in want]
    show = lambda v: "" if v is None or v != v else f"{v:.6f}" if isinstance(v, float) else str(v)
    return sorted(tuple(show(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_against_sql(spark, duck, name):
    df = core.queries()[name](spark, SF)
    cur = duck.execute(core.oracle_sql()[name])
    names = [c[0] for c in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.collect(), df.columns, names) == _rows(cur.fetchall(), names, names)


def test_ties_round_as_in_sql(spark, duck, tmp_path):
    """0.5055 times 1000 lies below the tie; Spark's own round goes by the decimal's digits."""
    docs = ", ".join(f"({k}, {n})" for k, n in enumerate((10110, 10230, 10350, 1010, 10, 9990, 500)))
    duck.execute(f"copy (select * from (values {docs}) t(doc_id, n_chars)) to '{tmp_path}/documents.parquet'")
    duck.execute(f"copy (select k::int AS doc_id, (k % 2)::int AS quality from range(7) t(k)) to '{tmp_path}/labels.parquet'")
    own = duckdb.connect()
    for name in ("documents", "labels"):
        own.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet'")
    df = core.queries()["pr_frontier"](spark, str(tmp_path))
    cur = own.execute(core.oracle_sql()["pr_frontier"])
    names = [c[0] for c in cur.description]
    assert _rows(df.collect(), df.columns, names) == _rows(cur.fetchall(), names, names)


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(core.oracle_sql()) <= set(core.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
