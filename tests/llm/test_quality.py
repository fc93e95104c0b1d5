import math
import random
import re

from panelspark.llm import quality
from pyspark.sql import functions as F


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    covered = {p for i, x in enumerate(wins) if wins.count(x) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def test_measures_against_brute_force(spark):
    rnd = random.Random(1)
    bits = ["a", "b", "ç!", "#x", "\n", " ", "\t", "\x0b", "a b a b a", " ", "line\nline\n", "C&D"]
    texts = [None, "", " ", "\n\n", "one", "a b", "a a a a", "x\n\nx\n x\nx"] + ["".join(rnd.choice(bits) + rnd.choice([" ", ""]) for _ in range(rnd.randint(1, 80))) for _ in range(80)]
    texts += ["w " * 3000, "z" * 100_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {r.doc_id: r for r in quality.measure(docs, "text").collect()}
    for i, t in enumerate(texts):
        if t != "w " * 3000:
            assert tuple(got[i][c] for c in quality.BASE) == brute(t), t
    assert got[len(texts) - 2].n_repeat_words == 3000


def test_binomial_tail(spark):
    rows = [(k, n) for n in (1, 5, 40, 700) for k in range(0, 8) if k <= n]
    df = spark.createDataFrame(rows, "k long, n long").withColumn("p", quality.binomial_tail(F.col("k"), F.col("n"), 0.01))
    for r in df.collect():
        want = sum(math.comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)) if r.k <= r.n * 0.01 else 1.0
        assert abs(r.p - want) < 1e-9


def labelled(spark, n=2400):
    rnd = random.Random(7)
    rows, marks = [], []
    for i in range(n):
        bad = i % 6 == 0
        words = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 9))) + ("###" if bad or rnd.random() < 0.01 else "") for _ in range(70)]
        rows.append((i, " ".join(words), rnd.choice(["en", "de"]) if i % 3 else None))
        if i % 2 == 0:
            marks.append((i, 0 if bad else 1))
    marks += [(None, 1), (0, 1), (10**9, 0), (2, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, quality int")


def test_rules_reject_bad_and_keep_good(spark):
    docs, labels = labelled(spark)
    measured = quality.measure(docs, "text").drop("text").cache()
    got = quality.judge(measured, labels, stratum=None).collect()
    assert len(got) == docs.count()
    bad = [r for r in got if r.doc_id % 6 == 0]
    good = [r for r in got if r.doc_id % 6]
    assert sum(not r.kept for r in bad) > 0.95 * len(bad)
    assert sum(not r.kept for r in good) <= 5 * quality.RISK * len(good)
    assert {r.lang for r in got} == {"en", "de", None}
    by_lang = quality.judge(measured, labels, stratum="lang")
    assert by_lang.count() == docs.count()


def test_own_names_as_columns(spark):
    docs, labels = labelled(spark, 600)
    own = ["stratum", "raw", "__cut", "__at", "__stratum", "cut", "id", "good", "__words"]
    measured = quality.measure(docs.withColumns({c: F.lit(c) for c in own}).withColumns({"kept": F.lit("clash"), "failed_rules": F.lit("clash")}), "text").drop("text").cache()
    got = quality.keep(quality.judge(measured, labels, stratum=None, risk=0.05))
    assert 0 < got.count() < 600 and all(r[c] == c for r in got.collect() for c in own)
    assert [r.stratum for r in quality.judge(measured, labels, stratum="stratum").limit(1).collect()] == ["stratum"]


def test_every_stratum_has_its_own_cutoffs_broadcast_or_not(spark, monkeypatch):
    docs, labels = labelled(spark)
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 12 < 6, "a").otherwise("b")).unionByName(spark.createDataFrame([(9000, " ".join(["abc###"] * 30 + [f"w{k}" for k in range(60)]), "unlabelled")], docs.schema))
    measured = quality.measure(docs, "text").drop("text").cache()
    both = []
    for most in (10_000, 0):
        monkeypatch.setattr(quality, "STRATA", most)
        both.append(sorted(quality.judge(measured, labels, risk=0.05).select("doc_id", "kept", "failed_rules").collect()))
    assert both[0] == both[1]
    assert sum(not r.kept for r in both[0] if r.doc_id % 6 == 0 and r.doc_id < 2400) > 350
    assert [r.kept for r in both[0] if r.doc_id == 9000] == [True]  # no labels, no cutoffs


def test_no_labels_and_empty_table(spark):
    docs, labels = labelled(spark, 12)
    measured = quality.measure(docs, "text")
    assert all(r.kept for r in quality.judge(measured, labels.limit(0)).collect())
    assert quality.judge(measured.limit(0), labels).collect() == []
