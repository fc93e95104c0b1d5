import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from panelspark.llm import common, token_files
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def rows():
    rnd = random.Random(5)
    bits = ["the", " ", "  ", "\n", "naïve", "<|endoftext|>", "!", " a", "\0", "漢字", "x" * 40, "\x1c"]
    out = [(k, "".join(rnd.choice(bits) for _ in range(rnd.choice([0, 1, 9, 60])))) for k in rnd.sample(range(500), 90)]
    return out + [(600, None), (601, ""), (602, "long " * 6000), (None, "no id"), (7000, " lead"), (7001, "trail "), (7002, "plain words only, here.")]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_files, "SEQUENCE", 16)
    monkeypatch.setattr(token_files, "BATCH", 4)
    docs = spark.createDataFrame(rows(), "doc_id long, text string").withColumn("tie", F.lit("clash")).repartition(3)
    shards = token_files.write_tokens(docs, common.fresh_path(spark, "tokens"), PATH)
    got = sorted(token_files.read_tokens(shards).collect(), key=lambda r: r.start)
    library, start = Tokenizer.from_file(PATH), 0
    for r, (i, text) in zip(got, sorted(rows(), key=lambda x: (x[0] is not None, x[0])), strict=True):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i, start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_random_access_copies_nothing(spark, tmp_path):
    ids = np.arange(5000, dtype="<u2")
    with open(tmp_path / "s", "wb") as f:
        w = token_files.ShardWriter(f, np.dtype("<u2"))
        w.add(ids[:10])
        w.add(ids[10:])
        w.close()
    shard = token_files.ShardReader(pa.memory_map(str(tmp_path / "s")))
    before = pa.total_allocated_bytes()
    got, mask = shard.sequence(1)
    assert (got == ids[2048:4096]).all() and not got.flags.owndata and all(mask.to_pylist())
    assert (shard.tokens(100, 4500) == ids[100:4600]).all()
    assert len(shard) == 3 and sum(shard.sequence(2)[1].to_pylist()) == 5000 - 4096
    assert pa.total_allocated_bytes() - before < 1000


def test_rows_that_repeat_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "b"), (1, "a")], "doc_id long, text string")
    got = token_files.read_tokens(token_files.write_tokens(docs, common.fresh_path(spark, "tokens"), PATH)).collect()
    assert sorted(r.start for r in got) == [0, 2, 4] and len({bytes(r.ids) for r in got}) == 2
    none = token_files.write_tokens(docs.limit(0), common.fresh_path(spark, "tokens"), PATH)
    assert token_files.read_tokens(none).collect() == []
    assert zlib.crc32(b"") == 0
