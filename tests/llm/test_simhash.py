import random

import pytest
import xxhash
from panelspark.llm import common, simhash
from pyspark.sql import functions as F


def brute(rows):
    """fingerprints and components straight from the definition."""
    prints = []
    for _, text in rows:
        words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ") if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    return prints, components(prints, [i for i, _ in rows])


def components(prints, ids):
    parent = list(range(len(prints)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[top(i)] = top(j)
    least = {}
    for i, d in enumerate(ids):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [least.get(top(i)) for i in range(len(prints))]


def test_seed_and_hash_are_those_of_spark(spark):
    got = spark.sql("select xxhash64('a b ç') h").first().h
    assert got & (1 << 64) - 1 == xxhash.xxh64_intdigest("a b ç".encode(), 42)


@pytest.mark.parametrize("hot, fine", [(100_000, False), (4, True)])
def test_rows_against_brute_force(spark, monkeypatch, hot, fine):
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "HOT_KEYS", 10)
    monkeypatch.setattr(simhash, "GRID_NODES", 0 if fine else 1 << 27)
    rnd = random.Random(4)
    words = ["Alpha", "beta", "ç", "Δelta", "e", "f\x0bg", "h i"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 2, 3, 4, 40, 300])))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n\t"), (203, rows[3][1]), (203, rows[3][1]), (None, rows[5][1]), (204, rows[50][1] + " x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = simhash.near_duplicates(docs, "doc_id", "text").collect()
    prints, roots = brute(rows)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([(r.doc_id, r.fp, r.component_id) for r in got], key=key) == sorted(zip([i for i, _ in rows], map(signed, prints), roots, strict=True), key=key)
    kept = simhash.keep_one(docs).collect()
    assert len(kept) == len({r.root for r in got})
    assert {r.doc_id for r in kept} == {r for r in roots}


@pytest.mark.parametrize("hot", [100_000, 4])
def test_crowded_cells_lose_no_link(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "CELL_NODES", 3)
    monkeypatch.setattr(common, "HOT_ROWS", hot)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    rnd = random.Random(2)
    base = [rnd.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base[:3]:
        for _ in range(60):
            prints.add(b ^ sum(1 << k for k in rnd.sample(range(12), rnd.randint(1, 4))))
    for b in base[3:]:
        for _ in range(30):
            prints.add(b ^ sum(1 << k for k in rnd.sample(range(64), rnd.randint(1, 4))))
    prints = sorted(prints)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    roots = {r.node: r.root for r in simhash.components(simhash.links(nodes)).collect()}
    want = components(prints, signed)
    assert [roots.get(x, x) for x in signed] == want


def test_one_text_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = [(i, "the same text in most rows") for i in range(400)] + [(i, None) for i in range(400, 600)] + [(i, f"other {i} words {i * 7} and {i * 31} more") for i in range(600, 640)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, "doc_id", "text").collect()}
    assert len(got) == 640 and {got[i] for i in range(400)} == {0} and {got[i] for i in range(400, 600)} == {400}
    assert simhash.keep_one(docs).count() == len(set(got.values()))


def test_keep_one_keeps_all_columns_and_settles_ties(spark):
    rows = [(1, "a b c d", x, y, 0) for x, y in (("p", 1), ("q", 2), ("r", 3))] + [(2, "a b c d", "s", 4, 0)]
    schema = "doc_id long, text string, __row_key string, root long, row int"
    kept = [simhash.keep_one(spark.createDataFrame(r, schema)).collect() for r in (rows, rows[::-1])]
    assert kept[0] == kept[1] and len(kept[0]) == 1 and kept[0][0].doc_id == 1 and kept[0][0].asDict().keys() == {"doc_id", "text", "__row_key", "root", "row"}
    assert kept[0][0]["__row_key"] in "pqr"


def test_inner_tables_are_removed(spark):
    import os

    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    simhash.keep_one(spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, "x")], "doc_id long, text string")).collect()
    assert len(set(os.listdir(folder)) - before) <= 3


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs, "doc_id", "text").collect() == []
    assert simhash.keep_one(docs).collect() == []
