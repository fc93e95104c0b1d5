import csv
import hashlib
import io
import zipfile
import zlib

import pytest
from panelspark.contracts import ContractError
from panelspark.sources import archive
from pyspark.sql import functions as F


def test_combined_sums():
    for a, b in ((b"", b""), (b"abc", b""), (b"", b"xyz"), (b"abc" * 1000, b"q" * 77_777)):
        assert archive.combined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_same_bytes_and_a_plain_reader(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "PIECE_ROWS", 70)
    rows = spark.range(500).select((F.col("id") % 60).alias("a, b"), F.when(F.col("id") % 7 != 0, F.concat(F.lit('say "'), (F.col("id") % 90).cast("string"), F.lit('"\n ü '))).alias("text"))
    tables = {"rows": rows, "none": spark.range(0).toDF("x"), "one": spark.range(1).toDF("x")}
    first = archive.write_archive(spark, tables, str(tmp_path / "a.zip"), {"rows": ["a, b"]}, "Data").collect()
    archive.write_archive(spark, {n: t.repartition(5) for n, t in tables.items()}, f"file://{tmp_path}/b.zip", {"rows": ["a, b"]}, "Data")
    assert (tmp_path / "a.zip").read_bytes() == (tmp_path / "b.zip").read_bytes()
    with zipfile.ZipFile(tmp_path / "a.zip") as z:
        assert z.testzip() is None and z.namelist() == ["Data/rows.csv", "Data/none.csv", "Data/one.csv"]
        for r in first:
            data = z.read(r.name)
            assert (hashlib.sha256(data).hexdigest(), len(data), z.getinfo(r.name).compress_size, zlib.crc32(data)) == (r.sha256, r.n_bytes, r.n_packed, r.crc32)
        assert z.read("Data/none.csv") == b"x\n" and z.read("Data/one.csv") == b"x\n0\n"
        got = list(csv.reader(io.StringIO(z.read("Data/rows.csv").decode(), newline="")))
    want = [(i % 60, f'say "{i % 90}"\n ü ' if i % 7 else "") for i in range(500)]
    assert got[0] == ["a, b", "text"] and sorted((int(a), t) for a, t in got[1:]) == sorted(want) and [int(r[0]) for r in got[1:]] == sorted(w[0] for w in want)
    assert {r.name: r.n_rows for r in first} == {"Data/rows.csv": 500, "Data/none.csv": 0, "Data/one.csv": 1}


def test_what_isnt_as_the_manifest_says(spark, tmp_path):
    at = str(tmp_path / "a.zip")
    manifest = archive.write_archive(spark, {"t": spark.range(9).toDF("x")}, at)
    archive.require_archive(at, manifest)
    with pytest.raises(ContractError, match="t.csv"):
        archive.require_archive(at, manifest.withColumn("sha256", F.lit("0")))
    with pytest.raises(ContractError, match="shared as files"):
        archive.write_archive(spark, {}, "hdfs://x/a.zip")
