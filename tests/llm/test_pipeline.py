"""The pipeline against a brute-force version of its stages, on a small fixture."""

import hashlib
import math
import random
import re

import public_tokenizers
import pytest
from panelspark.llm import pii, pipeline, quality
from pyspark.sql import functions as F
from test_pii import brute as spans_of
from test_quality import brute as measures_of
from test_simhash import brute as components_of
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(6)
    word = lambda: "".join(rnd.choice("abcdefg") for _ in range(rnd.randint(2, 8)))
    text = lambda n: " ".join(word() for _ in range(n))
    bench = [(k, text(25)) for k in range(3)] + [(3, None)]
    docs = [(k, text(80)) for k in range(30)]
    docs += [(30, docs[0][1]), (31, docs[1][1] + " "), (32, docs[2][1].upper()), (33, "short one"), (34, "a b c " * 40), (35, None), (36, "")]
    docs += [(40, text(60) + " " + bench[1][1] + " " + text(9)), (41, text(60) + " call +1 (743) 555-3824 or a@b.org " + text(5)), (42, text(70) + " <|endoftext|> naïve")]
    docs += [docs[3], (None, text(66)), (None, docs[4][1])]
    docs += [(k, text(55)) for k in range(1000, 1640)] + [(k, " ".join(word() + "##" for _ in range(55))) for k in range(2000, 2060)]  # enough for a cutoff
    labels = [(0, 1, 0), *((k, 1, 0) for k in range(1000, 1640)), *((k, 0, 0) for k in range(2000, 2040)), (1001, None, 1), (None, 0, 0), (-5, 0, 0)]
    at = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, None if i == 5 else "en", f"s{(i or 0) % 3}", len(t or ""), "x") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, docs, bench, labels


def measures(t):
    """The measures of the rules, and whether the base rule fails; straight from their definitions."""
    n, chars, symbols, dup, repeats = measures_of(t)
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    share = lambda a, b: a / b if b else 0.0
    m = {"symbol_ratio": share(symbols, chars), "upper_ratio": share(sum("A" <= c <= "Z" for c in t or ""), chars), "dup_line_ratio": share(dup, len(lines)), "repeat_ratio": share(repeats, n), "mean_word_chars": share(chars, n)}
    return m, n < 50 or 100 * repeats > 50 * n


def brute_cutoffs(rows):
    """rows: (stratum, good, measures). Exact tails, from the most lenient cutoff on until one fails; the one with most gained."""
    found, cells = {}, {(s, r) for s, _, _ in rows for r in quality.RULES}
    for s, r in cells:
        good, bad = ([m[r] for x, g, m in rows if x == s and g == want] for want in (True, False))
        best = None
        for cutoff in sorted(quality.RULES[r], reverse=True):
            k, caught = sum(x > cutoff for x in good), sum(x > cutoff for x in bad)
            tail = sum(math.comb(len(good), i) * 0.01**i * 0.99 ** (len(good) - i) for i in range(k + 1)) if k <= 0.01 * len(good) else 1.0
            if tail > 0.05 / len(cells):
                break
            best = max([b for b in (best, (caught - k, cutoff) if caught > k else None) if b], default=None)
        if best:
            found[s, r] = best[1]
    return found


def words_of(text):
    """Words again, written apart from the operator."""
    return [w for w in "".join(c.lower() if "A" <= c <= "Z" else c if c.isascii() and c.isalnum() or c > "\x7f" else " " for c in text or "").split(" ") if w]


def brute(docs, bench, labels):
    marks = {}
    for i, q, _ in labels:
        if i is not None and q is not None:
            marks[i] = min(q, marks.get(i, q))
    stratum = lambda i: "" if i == 5 else "en"
    measured = [(i, t, *measures(t)) for i, t in docs]
    cutoffs = brute_cutoffs([(stratum(i), marks[i] > 0, m) for i, _, m, failed in measured if i in marks and not failed])
    assert ("en", "symbol_ratio") in cutoffs
    kept = [(i, t) for i, t, m, failed in measured if not failed and not any(m[r] > cutoffs.get((stratum(i), r), math.inf) for r in m)]
    _, roots = components_of(kept)
    first = {}
    for (i, t), root in zip(kept, roots, strict=True):
        if i == root and root not in first:
            first[root] = (i, t)
    windows = {tuple(w[k : k + 10]) for _, b in bench for w in [words_of(b)] for k in range(len(w) - 9)}
    clean = []
    for i, t in first.values():
        w = words_of(t)
        if not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9)):
            clean.append((i, t))
    library, out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), []
    for i, t in clean:
        for start, kind, end in reversed(spans_of(t)):
            t = f"{t[:start]}[{pii.KINDS[kind].upper()}]{t[end:]}"
        ids = library.encode(t, add_special_tokens=False).ids
        out.append((i, ids, hashlib.sha256(t.encode()).hexdigest()))
    return out


def test_pipeline_against_brute_force(spark, tables):
    at, docs, bench, labels = tables
    got = pipeline.run(spark, at).collect()
    want = brute(docs, bench, labels)
    # a null id is no component's least id; the one document whose component has only a null id is told by its text
    key = lambda r: str(r[0])
    assert sorted(((r.doc_id, r.ids, r.decoded_sha256) for r in got), key=key) == sorted(want, key=key)
    assert {41, 42, 5} <= {r.doc_id for r in got} and not {30, 31, 32, 33, 34, 35, 36, 40, *range(2000, 2060)} & {r.doc_id for r in got}


def test_stages_keep_the_columns(spark, tables):
    at = tables[0]
    docs = spark.read.parquet(f"{at}/documents.parquet")
    assert len(pipeline.STAGES) == 5
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), at).collect() == []
    changed = pipeline.personal_data(spark, docs, at).filter("doc_id = 41").first()
    assert "[PHONE] or [EMAIL]" in changed.text and changed.n_chars == len(changed.text)


def test_stages_take_columns_of_their_own_names(spark, tables):
    at = tables[0]
    own = ["__doc", "__text", "__row", "__row_key", "__cut", "__stratum", "__at", "spans", "candidates", "kept", "failed_rules", "stratum", "fp", "root", "found", "ids"]
    docs = spark.read.parquet(f"{at}/documents.parquet").drop("lang", "source", "n_chars").filter("doc_id < 60").withColumns({c: F.lit(c) for c in own})
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.dtypes == docs.dtypes and all(r[c] == c for r in out.collect() for c in own), name
    assert pipeline.STAGES[-1][1](spark, docs, at).columns[0] == "doc_id"
