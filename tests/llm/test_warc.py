import base64
import hashlib

import pyarrow as pa
import pytest
import zstandard
from panelspark.llm import common, warc
from pyspark.sql import functions as F

ROWS = [(k, f"http://a/{k}\r\nX: y", f"<p>page {k % 7}</p>" + "long text ç " * (k % 5)) for k in range(60)]
ROWS += [(70, None, None), (71, "u", ""), (72, "v", "é" * 50_000), (None, "w", "only here"), (None, "w", ROWS[0][2]), (73, "x", ROWS[0][2]), (70, None, None)]


def want(rows, least):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    out = []
    for i, _, h in rows:
        raw = (h or "").encode()
        revisit = len(raw) >= least and i != first.get(h or "")
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first.get(h or "") if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least, hot, copied", [(0, 100_000, 100_000), (30, 100_000, 2), (0, 5, 1), (30, 5, 0), (30, 5, 100)])
def test_round_trip(spark, monkeypatch, least, hot, copied):
    monkeypatch.setattr(warc, "COPIED", copied)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    monkeypatch.setattr(warc, "RUN_BYTES", 400)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 40_000)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("payload_key", F.lit(1))
    runs = warc.write_archives(pages, common.fresh_path(spark, "warc"), least_bytes=least)
    got = warc.read_archives(runs).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == want(ROWS, least)
    texts = {r[0]: r[2] or "" for r in ROWS}
    assert all(r.payload == texts[r.page_id] for r in got if r.record_type == "response" and r.page_id is not None)


def test_whole_archive_reads_with_a_plain_decoder(spark):
    pages = spark.createDataFrame(ROWS * 4, "page_id long, url string, html string").coalesce(1)
    folder = common.fresh_path(spark, "warc")
    runs = warc.write_archives(pages, folder).collect()
    at, path = common.file_system(runs[0].path)
    data = at.open_input_file(path).read()
    size = int.from_bytes(data[4:8], "little") if data[:4] == bytes.fromhex("5d2a4d18") else None
    assert size
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).stream_reader(data[8 + size :], read_across_frames=True)
    whole = reader.read()
    assert whole.startswith(b"WARC/1.1\r\n") and whole.count(b"\r\nWARC-Record-ID: ") == sum(r.records for r in runs if r.path == runs[0].path)


def test_broken_records_are_found():
    raw = warc.record(5, "u", b"abc", hashlib.sha1(b"abc").digest(), 3, None, None, "1970-01-01T00:00:00Z")
    assert warc.parse(raw)["payload"] == "abc"
    for bad in (raw[:-1], raw.replace(b"abc", b"abd"), raw.replace(b"WARC/1.1", b"WARD/1.1"), raw.replace(b"WARC-Date", b"WARC-Dat")):
        with pytest.raises(warc.BadArchive):
            warc.parse(bad)
    packed = zstandard.ZstdCompressor().compress(raw)
    assert list(warc.frames(packed + packed, None)) == [raw, raw]
    with pytest.raises(warc.BadArchive):
        list(warc.frames(packed[:-3], None))
    with pytest.raises(warc.BadArchive):
        warc.read_dictionary(pa.BufferReader(warc.dictionary_frame(b"x" * 40)[:20]))


def shuffled(node):
    """Output columns of each shuffle in a physical plan."""
    if node.nodeName().startswith("AdaptiveSparkPlan"):
        return shuffled(node.executedPlan())
    below = [x for k in range(node.children().size()) for x in shuffled(node.children().apply(k))]
    return below + ([node.output().mkString(",")] if node.nodeName() == "Exchange" else [])


def test_payloads_stay_in_place_and_inner_tables_go(spark, monkeypatch, tmp_path):
    """No plan that writes archives shuffles html, and nothing but archives and their runs is left."""
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    plans, real = [], common.written

    def written(df, what):
        plans.append((what, shuffled(df._jdf.queryExecution().executedPlan())))
        return real(df, what)

    monkeypatch.setattr(common, "written", written)
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # so that only what is marked is broadcast
    try:
        assert warc.write_archives(pages, common.fresh_path(spark, "warc")).count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(len(found) for what, found in plans) > 0 and [found for what, found in plans if any("html" in x for x in found)] == []
    assert sorted(p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()) == ["warc", "warc-runs"]


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.write_archives(pages, common.fresh_path(spark, "warc"))).collect() == []
