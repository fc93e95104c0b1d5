import random

import numpy as np
import pytest
from panelspark.llm import common, suffix_dedup
from pyspark.sql import functions as F


def brute(rows, length):
    """Spans straight from the definition."""
    least = {}
    for i, text in rows:
        data, owner = (text or "").encode(), suffix_dedup.LAST if i is None else i
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            least[w] = min(owner, least.get(w, owner))
    out = []
    for i, text in rows:
        data, owner = (text or "").encode(), suffix_dedup.LAST if i is None else i
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            if least[data[p : p + length]] < owner:
                gone[p : p + length] = [True] * length
        edges = [p for p in range(len(data) + 1) if (p < len(data) and gone[p]) != (p > 0 and gone[p - 1])]
        out.append((i, len(data), list(zip(edges[::2], edges[1::2], strict=True)), bytes(b for b, g in zip(data, gone, strict=True) if not g)))
    return out


def got(docs, **kw):
    return [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.repeated_passages(docs, "doc_id", "text", **kw).collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


def corpus(seed):
    rnd = random.Random(seed)
    words = ["alpha", "bet", "ç", "Δelta", "e", "\n", "long-winded", "x" * 30]
    text = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage, line = text(40), "This line stands in a third of all documents, as it is."
    rows = [(i, text(rnd.choice([1, 5, 60, 200]))) for i in range(0, 60, 2)]
    rows += [(i, text(9) + passage[rnd.randrange(30) :] + text(7)) for i in range(61, 90)]
    rows += [(i, text(rnd.randrange(9)) + line + text(rnd.randrange(9))) for i in range(100, 140)]
    rows += [(3, rows[4][1]), (7, rows[4][1][10:-10]), (9, "ab" * 300), (11, "ab" * 200), (13, "z" * 900), (2**40, "z" * 400), (-5, text(30))]
    rows += [(201, None), (202, ""), (203, "short"), (203, "short"), (204, passage), (204, passage), (None, passage), (None, passage + "!"), (None, None)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, hot, piece", [(1, 8192, 1 << 17), (2, 5, 64), (3, 1, 1)])
def test_rows_against_brute_force(spark, monkeypatch, seed, hot, piece):
    """Hot keys, texts cut into pieces and slices of few suffixes give the same rows."""
    monkeypatch.setattr(suffix_dedup, "HOT_TEXTS", hot)
    monkeypatch.setattr(suffix_dedup, "FILE_ROWS", 37)
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 3000)
    monkeypatch.setattr(suffix_dedup, "PIECE_BYTES", max(piece, 64))
    monkeypatch.setattr(suffix_dedup, "SLICE", 1 << 20 if seed == 1 else 50)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).select("*", F.lit(1).alias("spans"), F.lit(2).alias("id"), F.lit("x").alias("kept"))
    assert ordered(got(docs)) == ordered(brute(rows, 50))


def test_other_lengths(spark):
    rows = corpus(5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for length, gram in ((8, 2), (20, 20), (200, 31)):
        assert ordered(got(docs, length=length, gram=gram)) == ordered(brute(rows, length))
    with pytest.raises(ValueError):
        suffix_dedup.repeated_passages(docs, "doc_id", "text", length=10, gram=11)


def test_suffix_order_and_previous_factors():
    rnd = random.Random(7)
    for depth in (3, 8, 11, 50):
        data = bytes(rnd.choice(b"ab") for _ in range(300)) + b"ab" * 60 + bytes(depth)
        at = np.array(rnd.sample(range(len(data) - depth), 250))
        order, same = suffix_dedup.suffix_order(np.frombuffer(data, "u1"), at, depth)
        heads = [data[p : p + depth] for p in at[order]]
        assert heads == sorted(heads) and same.tolist() == [False] + [x == y for x, y in zip(heads, heads[1:], strict=False)]
        owner = np.array([rnd.randrange(9) for _ in at])
        hit = suffix_dedup.previous_factors(owner, same)
        assert hit.tolist() == [any(h == g and owner[j] < owner[i] for j, g in enumerate(heads)) for i, h in enumerate(heads)]


def test_keys_depend_on_windows_alone():
    rnd = random.Random(1)
    window = bytes(rnd.randrange(256) for _ in range(50))
    keys = {int(suffix_dedup.window_keys(np.frombuffer(bytes(rnd.randrange(256) for _ in range(k)) + window + bytes(k), "u1"), 50, 24)[k]) for k in range(40)}
    assert len(keys) == 1


def test_long_text_and_many_copies(spark):
    """A text longer than a block and a piece, and one text that holds most rows."""
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(400_000))
    rows = [(5, long), (6, "new " + long[150_000:]), (7, "own text")] + [(i, long[:300]) for i in range(10, 400)]
    out = {r[0]: r for r in got(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))}
    assert out[5][2] == [] and out[6][2] == [(4, 250_004)] and out[6][3] == b"new " and out[7][2] == []
    assert all(out[i][2] == [(0, 300)] for i in range(10, 400))


def test_inner_tables_and_empty_table(spark):
    import os

    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert got(spark.createDataFrame([], "doc_id long, text string")) == []
    assert len(set(os.listdir(folder)) - before) <= 3
