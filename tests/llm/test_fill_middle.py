import gc
import hashlib
import random
import re

import pyarrow as pa
import pytest
from panelspark.llm import fill_middle
from pyspark.sql import functions as F


def brute(doc_id, text):
    """n, form, prefix_chars, middle_chars and output, straight from the definition."""
    text = text or ""
    words = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(words), "plain", None, None, text
    a, b = sorted((h[0] % (len(words) + 1), h[1] % (len(words) + 1)))
    p, m, s = "".join(words[:a]), "".join(words[a:b]), "".join(words[b:])
    form = "spm" if h[3] % 100 < 20 else "psm"
    return len(words), form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


def texts():
    rnd = random.Random(1)
    parts = ["word", "Ç", "é", "\n", " ", "<", "S", ">", "<S", "P>", "1234", "\r\n", "𝄞", "é", " ", "M", "\t", "\x00"]
    out = ["".join(rnd.choice(parts) for _ in range(rnd.choice([1, 2, 5, 40, 300]))) for _ in range(300)]
    return out + [None, "", "<P>", "a <M> b", "<<S>", "x" * 5000, "ab " * 4000, "é" * 3000]


@pytest.mark.parametrize("piece", [1 << 16, 7])
def test_rows_against_brute_force(spark, monkeypatch, piece):
    monkeypatch.setattr(fill_middle, "PIECE", piece)
    rows = [(i * 7 - 100, t) for i, t in enumerate(texts())] + [(None, "no id here"), (3, "same row"), (3, "same row")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("*", F.lit("clash").alias("form"), F.lit(5).alias("cuts"), F.lit(1).alias("N"))
    done = fill_middle.fill_in_middle(docs, "doc_id", "text").withColumn("back", fill_middle.restored("output", "form"))
    assert {"doc_id", "text", "cuts", "n", "form", "output"} <= set(done.columns) and "N" not in done.columns
    key = lambda r: (r[0] is None, r[0] or 0)
    got = sorted([(r.doc_id, r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in done.collect()], key=key)
    assert got == sorted([(i, t, *brute(i, t)) for i, t in rows], key=key)
    assert done.filter("NOT back <=> coalesce(text, '')").count() == 0
    assert {r[3] for r in got} == {"plain", "psm", "spm"}


def test_pieces_join_to_the_same_tokens(monkeypatch):
    for t in texts():
        if t:
            monkeypatch.setattr(fill_middle, "PIECE", 1 << 16)
            whole = fill_middle.token_ends(t).tolist()
            for piece in (1, 3, 50):
                monkeypatch.setattr(fill_middle, "PIECE", piece)
                assert fill_middle.token_ends(t).tolist() == whole


def test_empty_table(spark):
    assert fill_middle.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").collect() == []


def test_tokens_set_off_no_search_for_cycles():
    text, found = "ab, " * 5000, []
    gc.callbacks.append(seen := lambda phase, info: found.append(phase))
    try:
        (got,) = fill_middle._cuts(iter([(pa.array([text]), pa.array([7]), pa.array([15_001]))]))
    finally:
        gc.callbacks.remove(seen)
    assert got.to_pylist() == [{"n": 15_000, "a": 0, "b": 10}] and gc.isenabled()
    assert found.count("start") <= 3  # when it is on again, not for each thousand tokens


def test_cuts_and_tokens_of_the_pattern_itself():
    from tokenizers import Regex, pre_tokenizers

    plain = pre_tokenizers.Split(Regex(fill_middle.PATTERN), "isolated")
    for k, t in enumerate(t for t in texts() if t):
        ends = [end for _, (_, end) in plain.pre_tokenize_str(t)]
        assert fill_middle.token_ends(t).tolist() == ends
        low, high = sorted(h % (len(ends) + 1) for h in (7 * k, 13 * k))
        assert fill_middle.cuts_of(t, 7 * k, 13 * k) == (len(ends), *([0, *ends][h] for h in (low, high)))
