import hashlib

import numpy as np
import pytest
from panelspark.contracts import ContractError
from panelspark.operators import ranges, splits


# How many areas two published tables of five folds have, and the SHA-256 of their folds' digits in the areas' order.
PUBLISHED = {
    646: "f3e0a8042fc8a753e11b61611fd954140938b184bd539cde11bc07a9d60b35ef",
    1198: "2102861e279dd46d4126a6a934856de0084d3744535f029efb057ab233abd9ce",
}


@pytest.mark.parametrize("n", sorted(PUBLISHED))
def test_folds_are_the_published_ones(spark, n):
    areas = spark.range(n).selectExpr("id * 7 - 90 AS area").unionByName(spark.sql("SELECT CAST(NULL AS LONG) AS area UNION ALL SELECT -90L"))
    folds = [r.fold for r in splits.entity_folds(areas, "area", 5).orderBy("area").collect()]
    assert len(folds) == n and hashlib.sha256("".join(map(str, folds)).encode()).hexdigest() == PUBLISHED[n]


def test_folds_of_few_or_none(spark, monkeypatch):
    assert splits.entity_folds(spark.range(0), "id", 5).collect() == []
    with pytest.raises(ContractError, match="3 entities for 5"):
        splits.entity_folds(spark.range(3), "id", 5)
    monkeypatch.setattr(splits, "PERMUTED", 10)
    with pytest.raises(ContractError, match="more than 10"):
        splits.entity_folds(spark.range(11), "id", 5)


def test_sample_is_the_generators(spark):
    """Group c is large enough, and drawn from densely enough, for each of the generator's ways to choose."""
    sizes = {"a": (40, 7), "b": (1, 1), "c": (12_000, 600), "d": (12_000, 50), "e": (5, 0)}
    rows = [(g, i * 3 + ord(g)) for g, (n, _) in sizes.items() for i in range(n)]
    entities = spark.createDataFrame([*rows, (None, 1), ("a", None)], "grp string, area long").repartition(7)
    got = splits.seeded_sample(entities, "area", "grp", spark.createDataFrame([(g, q) for g, (_, q) in sizes.items()], "grp string, quota long"), 3).collect()
    rng, want = np.random.default_rng(3), set()
    for g, (n, quota) in sizes.items():
        if quota:
            want |= {(g, int(x)) for x in rng.choice(np.arange(n) * 3 + ord(g), size=quota, replace=False)}
    assert {(r.grp, r.area) for r in got} == want and len(got) == len(want)


def test_sample_of_too_many(spark):
    with pytest.raises(ContractError, match="3 of 2"):
        splits.seeded_sample(spark.createDataFrame([("a", 1), ("a", 2)], "g string, e long"), "e", "g", spark.createDataFrame([("a", 3)], "g string, quota long"))


def test_ranks_by_group(spark):
    rows = spark.createDataFrame([(g, v) for g in ("x", None) for v in range(-500, 500)], "g string, v long").repartition(5)
    got = {(r.g, r.v): r.n for r in ranges.ranked(rows, ["g"], "v", "n").collect()}
    assert got == {(g, v): v + 500 for g in ("x", None) for v in range(-500, 500)}
