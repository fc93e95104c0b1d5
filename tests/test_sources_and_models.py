import numpy as np
import pytest
from panelspark import contracts, sources
from panelspark.plans import attribution, models, probit
from panelspark.sources import digests, publish
from panelspark.streaming import previous_values, windowed_panel
from pyspark.sql import functions as F
from pyspark.sql import types as T


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿id,x\n1,0.1\n2,NaN\n3,Infinity\n", encoding="utf-8")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.DoubleType())])
    text = sources.read_csv_text(spark, str(tmp_path / "a.csv")).orderBy("source_row").collect()
    assert [(r.id, r.x, r.source_row) for r in text] == [("1", "0.1", 2), ("2", "NaN", 3), ("3", "Infinity", 4)] and text[0].source_file == "a.csv"
    (tmp_path / "b.csv").write_text("id,x\n1,0.1\n2,NaN\n3,Infinity\n")
    assert [r.x for r in sources.read_csv(spark, str(tmp_path / "b.csv"), schema).orderBy("id").collect()] == [0.1, None, None]
    publish.write_csv(spark.createDataFrame([(0.1 + 0.2, None)], "a double, b double"), str(tmp_path / "out"), {"a": "%.6f", "b": "%.17g"})
    assert spark.read.csv(str(tmp_path / "out"), header=True).first().a == "0.300000"
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        publish.write_csv(spark.range(1).toDF("a"), str(tmp_path / "out"))


def test_publish_restores_what_it_replaced(spark, tmp_path):
    at = str(tmp_path / "pub")
    publish.publish(spark, {"a": spark.range(3).toDF("x"), "b": spark.range(2).toDF("x")}, at)
    first = publish.read_json(spark, f"{at}/manifest.json")
    assert first["a"]["n_rows"] == 3

    def bad(name, df):
        if name == "b":
            raise ValueError("not valid")

    with pytest.raises(ValueError):
        publish.publish(spark, {"a": spark.range(9).toDF("x"), "b": spark.range(9).toDF("x")}, at, validate=bad)
    assert spark.read.parquet(f"{at}/a").count() == 3 and publish.read_json(spark, f"{at}/manifest.json") == first


def test_a_failing_manifest_restores_everything(spark, tmp_path, monkeypatch):
    at = str(tmp_path / "pub")
    first = publish.publish(spark, {"a": spark.range(3).toDF("x")}, at)
    real = publish._move

    def stop(session, fs, src, dst, retries):
        if src.endswith("manifest.json") and ".stage" in src:
            raise OSError("no")
        real(session, fs, src, dst, retries)

    monkeypatch.setattr(publish, "_move", stop)
    with pytest.raises(OSError):
        publish.publish(spark, {"a": spark.range(9).toDF("x"), "b": spark.range(1).toDF("x")}, at)
    assert publish.read_json(spark, f"{at}/manifest.json") == first and spark.read.parquet(f"{at}/a").count() == 3 and not (tmp_path / "pub" / "b").exists()
    publish.require_bundle(spark, at)


def test_a_stop_while_saving_leaves_the_old_checkpoint(spark, tmp_path, monkeypatch):
    store = publish.CheckpointStore(spark, str(tmp_path / "cp"))
    store.save("f", spark.range(5).toDF("x"), {"seed": 1})
    with monkeypatch.context() as m:
        m.setattr(publish, "write_json", lambda *a: (_ for _ in ()).throw(OSError("stopped")))
        with pytest.raises(OSError):
            store.save("f", spark.range(7).toDF("x"), {"seed": 2})
    assert store.load("f", {"seed": 1}).count() == 5 and store.load("f", {"seed": 2}) is None
    assert store.get("f", {"seed": 2}, lambda: spark.range(7).toDF("x")).count() == 7 and store.load("f", {"seed": 1}) is None


def test_checkpoints_are_reused_only_for_the_same_manifest(spark, tmp_path):
    store, made = publish.CheckpointStore(spark, str(tmp_path / "cp")), []
    make = lambda: (made.append(1), spark.range(5).toDF("x"))[1]
    for manifest in ({"seed": 1}, {"seed": 1}, {"seed": 2}):
        assert store.get("fold0", manifest, make).count() == 5
    assert len(made) == 2
    a, b = (contracts.table_digest(df).first() for df in (spark.range(9).toDF("x"), spark.range(9).toDF("x").orderBy(F.desc("x"))))
    assert a == b


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 3))
    z = 1.2 * x[:, 0] - 0.7 * x[:, 1] + rng.normal(size=1500)
    y = 1 + (z[:, None] > np.array([-1.0, 0.2, 1.4])[None, :]).sum(1)
    rows = [(float(a), float(b), float(c) if k % 9 else None, int(v), float(a * b + 0.1 * c)) for k, ((a, b, c), v) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c double, y int, t double").cache()


def test_ordered_probit_finds_its_parameters(frame):
    cuts, beta = probit.fit(frame, ["a", "b"], "y", 4)
    assert np.allclose(cuts, [-1.0, 0.2, 1.4], atol=0.15) and np.allclose(beta, [1.2, -0.7], atol=0.12)
    hit = probit.predict(frame, ["a", "b"], cuts, beta).agg(F.avg((F.col("predicted") == F.col("y")).cast("double"))).first()[0]
    assert hit > 0.5


def test_tree_attributions_add_up(frame):
    df, inputs = models.filled(frame, models.medians(frame, ["a", "b", "c"]))
    data = models.vector(df, inputs)
    model = models.gbt({"maxIter": 4, "maxDepth": 3, "stepSize": 0.3}, "t").fit(data)
    out, base = attribution.tree_shap(model.transform(data).drop("features"), model, inputs)
    gap = out.select(F.max(F.abs(F.lit(base) + F.aggregate("shap", F.lit(0.0), lambda s, v: s + v) - F.col("__p")))).first()[0]
    assert gap < 1e-9


def test_independent_columns(spark, frame):
    df = frame.withColumns({"copy": F.col("a"), "both": F.col("a") + 2 * F.col("b"), "flat": F.lit(1.0)})
    scaled, keep = models.standardised(df, df, ["a", "b", "copy", "both", "flat"])
    assert keep == ["a", "b", "copy", "both"] and models.independent(scaled, keep) == ["a", "b"]
    assert models.guarded("x", lambda: (_ for _ in ()).throw(ValueError("no"))) == ("not_estimable", "x: no", None)


def test_streams(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:05:00", 2.0), (2, "2024-01-01 00:03:00", 7.0)]
    spark.createDataFrame(rows, "user_id long, ts string, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = previous_values(stream, "user_id", "ts", "value").writeStream.format("memory").queryName("prev").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted((r.entity, r.value, r.previous) for r in spark.table("prev").collect()) == [(1, 1.0, None), (1, 2.0, 1.0), (2, 7.0, None)]
    assert sorted((r.user_id, r.n) for r in windowed_panel(batch, ["user_id"], "ts", "value").collect()) == [(1, 2), (2, 1)]


def test_differences_are_found_from_the_top_down(spark, tmp_path):
    rows = spark.range(20_000).selectExpr("id", "cast(id % 7 as int) a", "case when id % 5 > 0 then 'x' || id end b")
    changed = rows.filter("id <> 77").selectExpr("id", "case when id = 5 then 99 else a end a", "case when id = 10 then 'new' when id = 6 then null else b end b").unionByName(spark.sql("select -1L id, 0 a, 'y' b"))
    at = [str(tmp_path / n) for n in ("one", "two", "same")]
    for df, folder in zip((rows, changed, rows.repartition(7)), at, strict=True):
        digests.write_digested(df, ["id"], folder)
    got = {(r.id, r.status, r.columns) for r in digests.differences(spark, at[0], at[1], ["id"]).collect()}
    assert got == {(77, "only_left", ""), (-1, "only_right", ""), (5, "changed", "a"), (10, "changed", "b"), (6, "changed", "b")}
    assert digests.differing_ranges(spark, at[0], at[2]) == [] and digests.differences(spark, at[0], at[2], ["id"]).count() == 0
    ranges = digests.differing_ranges(spark, at[0], at[1])
    assert 1 <= len(ranges) <= 5
    plan = digests.differences(spark, at[0], at[1], ["id"])._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "__range" in plan.split("PushedFilters")[1][:200]
    with pytest.raises(contracts.ContractError):
        digests.write_digested(rows.unionByName(rows.limit(1)), ["id"], str(tmp_path / "bad"))
    with pytest.raises(contracts.ContractError):
        digests.write_digested(rows.unionByName(spark.sql("select null id, 0 a, 'y' b")), ["id"], str(tmp_path / "bad"))
