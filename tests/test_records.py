import csv
import io

import pytest
from panelspark import sources
from panelspark.sources import read_records


def plain(data):
    """Numbered rows as Python's reader gives them."""
    return [(i, r) for i, r in enumerate((r for r in csv.reader(io.StringIO(data.decode("utf-8-sig"), newline="")) if r), 1)]


def write(path, rows, end):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end).writerows(rows)
    path.write_bytes(out.getvalue().encode())
    return path.read_bytes()


ROWS = [["id", "note", "tail"]] + [[str(i), f'line one of "{i}"\nand, two\n\n"' * (i % 5) + "é" * (i % 3), "x" * (i % 41)] for i in range(400)]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [700, 1 << 20])
def test_places_however_files_are_cut(spark, tmp_path, end, size):
    data = write(tmp_path / "a.csv", ROWS, end)
    got = {r.source_row: r.text for r in read_records(spark, str(tmp_path / "a.csv"), size).collect()}
    assert sorted(got) == list(range(1, len(ROWS) + 1))
    for number, row in plain(data):
        assert next(csv.reader(io.StringIO(got[number], newline=""))) == row


def test_fields_and_several_files(spark, tmp_path):
    write(tmp_path / "a.csv", ROWS, "\n")
    write(tmp_path / "b c+d%20.csv", [ROWS[0], *ROWS[:50:-1]], "\n")
    got = {(r.source_file, r.source_row): (r.id, r.note or "", r.tail or "") for r in sources.read_csv_text(spark, str(tmp_path), 4000).collect()}
    want = {("a.csv", i): tuple(r) for i, r in enumerate(ROWS[1:], 2)} | {("b c+d%20.csv", i): tuple(r) for i, r in enumerate(ROWS[:50:-1], 2)}
    assert got == want


def test_one_record_over_many_splits(spark, tmp_path):
    data = write(tmp_path / "a.csv", [["id", "note"], ["1", "\n".join(["word"] * 500)], ["2", "after"]], "\n")
    got = {r.source_row: r.text for r in read_records(spark, str(tmp_path / "a.csv"), 300).collect()}
    assert {n: next(csv.reader(io.StringIO(t, newline=""))) for n, t in got.items()} == dict(plain(data))


def test_empty_lines_open_quotes_and_empty_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿id,x\n\n1,"a\n\nb"\n\r\n2,\n3,"open\nto the end\n'.encode())
    got = sorted((r.source_row, r.id, r.x) for r in sources.read_csv_text(spark, str(tmp_path / "a.csv"), 7).collect())
    assert got[:2] == [(2, "1", "a\n\nb"), (3, "2", None)] and [g[:2] for g in got[2:]] == [(4, "3")]
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "b.csv").write_bytes(b"")
    assert read_records(spark, str(tmp_path / "none" / "b.csv")).collect() == []


def test_two_batches_of_a_split_are_one(spark, tmp_path):
    data = write(tmp_path / "a.csv", ROWS, "\n")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.source_row: r.text for r in read_records(spark, str(tmp_path / "a.csv"), 3000).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {n: next(csv.reader(io.StringIO(t, newline=""))) for n, t in got.items()} == dict(plain(data))


def test_records_of_a_batch_are_one_batch_and_small_splits_share_tasks(spark, tmp_path, monkeypatch):
    import numpy as np
    import pyarrow as pa
    from panelspark.sources import records

    lines = ['1,"a', 'b"', "2,c", '3,"', '"', ""] * 500 + ['4,"open', "to the end"]
    batch = pa.RecordBatch.from_pydict({
        "split": pa.array(np.zeros(len(lines)), pa.int64()), "before": pa.array(np.zeros(len(lines)), pa.int64()), "inside": [False] * len(lines), "quotes": pa.array([x.count('"') for x in lines], pa.int64()), "blank": [x == "" for x in lines], "line": lines,
    })
    got = list(records._records(iter([batch])))
    texts = {n: t for b in got for n, t in zip(b.column("number").to_pylist(), b.column("text").to_pylist(), strict=True)}
    assert len(got) <= 2 and {n: next(csv.reader(io.StringIO(t, newline=""))) for n, t in texts.items()} == dict(plain("\n".join(lines).encode()))
    for k in range(100):
        write(tmp_path / f"{k}.csv", ROWS[:40], "\n")
    read = read_records(spark, str(tmp_path), 700)
    spark.sparkContext.setJobGroup("places", "places")
    try:
        assert read.count() == 4000
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    status = spark.sparkContext.statusTracker()
    tasks = [status.getStageInfo(s).numTasks for j in status.getJobIdsForGroup("places") for s in status.getJobInfo(j).stageIds if status.getStageInfo(s)]
    assert tasks and max(tasks) <= 2 * records.WAVES * spark.sparkContext.defaultParallelism + 2  # two readings, and what packing leaves over
