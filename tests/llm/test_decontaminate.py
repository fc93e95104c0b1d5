import random

import pytest
from panelspark.llm import decontaminate as d
from pyspark.sql import functions as F


def words_of(text):
    """Words again, written apart from the operator."""
    return "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or c > "\x7f" else " " for c in text or "").split(" ")


def brute(text, items):
    words, hit, found = [w for w in words_of(text) if w], set(), set()
    for item, t in items:
        w = [x for x in words_of(t) if x]
        k = min(10, len(w))
        for i in range(len(w) - k + 1) if w else ():
            for j in range(len(words) - k + 1):
                if words[j : j + k] == w[i : i + k]:
                    hit.update(range(j, j + k))
                    if item is not None:
                        found.add(str(item))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("table_words", [200_000, 25])
def test_against_brute_force(spark, monkeypatch, table_words):
    monkeypatch.setattr(d, "TABLE_WORDS", table_words)
    rnd = random.Random(3)
    vocab = ["A", "b", "ç", "d1", "E-e", "f."]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    items = [(k, text(n)) for k, n in enumerate([30, 12, 10, 9, 3, 1, 0, 40])] + [(20, None), (3, text(11)), (None, "zz yy"), (21, "  ?!")]
    docs = [(k, text(rnd.choice([0, 1, 5, 30, 200]))) for k in range(40)]
    docs += [(90, None), (91, items[0][1] + " x " + items[7][1].upper()), (91, "zz yy"), (None, "q " + items[2][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = d.contamination(spark.createDataFrame(docs, "doc_id long, text string").withColumn("n_hit", F.lit("clash")), "text", benchmark, "item_id", "text")
    key = lambda r: (r[0] is None, r[0], r[1:])
    rows = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids, r.contaminated) for r in got.collect()), key=key)
    want = sorted(((i, *brute(t, items)) for i, t in docs), key=key)
    assert rows == [(*w, w[2] > 0) for w in want]


def test_own_names_as_columns_and_one_item_beside_many(spark, monkeypatch):
    monkeypatch.setattr(d, "TABLE_WORDS", 30)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(words[:15])) for k in range(50)] + [(99, " ".join(words))]  # a window of 51 items, an item of 391 windows
    docs = spark.createDataFrame([(1, " ".join(["x", *words, "y"]), *"abcdef"), (2, "nothing here", *"abcdef")], "doc_id long, text string, found string, __row string, spans string, items string, f string, slice string")
    got = {r.doc_id: r for r in d.contamination(docs, "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").collect()}
    assert (got[1].n_hit, len(got[1].item_ids), got[2].n_hit) == (400, 51, 0)
    assert all([r[c] for c in ("found", "__row", "spans", "items", "f", "slice")] == list("abcdef") for r in got.values())


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert [(r.n_words, r.contaminated) for r in d.contamination(docs, "text", none, "item_id", "text").collect()] == [(2, False)]
    assert d.contamination(docs.limit(0), "text", none, "item_id", "text").collect() == []


def test_null_item_beside_another():
    items = [("7", "a b"), (None, "zz yy"), ("10", "yy a")]
    assert d.occurrences(d.tables(items), d.words_of("zz yy a b")) == ([(0, 4)], ["10", "7"])
