import hashlib
import math
import random

import numpy as np
from panelspark.llm import vector_codes
from pyspark.sql import functions as F


def brute(rows, entries=256):
    """code, error and label_error by row, and the codebooks' digest, in plain Python."""
    kept = [(i, [math.floor(1024 * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    parts = [[r[1][p * len(r[1]) // 4 : (p + 1) * len(r[1]) // 4] for r in kept] for p in range(4)]
    books = [[list(x) for x in part[:entries]] for part in parts]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda x, book: min((far(x, c), k) for k, c in enumerate(book))
    for _ in range(4):
        for part, book in zip(parts, books, strict=True):
            of = {}
            for x in part:
                of.setdefault(near(x, book)[1], []).append(x)
            for k, xs in of.items():
                book[k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    codes = [[near(part[n], book) for part, book in zip(parts, books, strict=True)] for n in range(len(kept))]
    errors = [sum(d for d, _ in c) for c in codes]
    by_label = {}
    for (_, _, g), e in zip(kept, errors, strict=True):
        by_label[g] = by_label.get(g, 0) + e
    text = ",".join(str(v) for book in books for c in book for v in c)
    return sorted([(i, "".join(f"{k:02x}" for _, k in c), e, by_label[g]) for (i, _, g), c, e in zip(kept, codes, errors, strict=True)], key=str), hashlib.sha256(text.encode()).hexdigest()


def check(spark, rows, kind="float"):
    frame = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3).select("*", F.lit("x").alias("code"), F.lit(1).alias("__ints"), F.lit(2).alias("id"))
    coded, books = vector_codes.compress(frame, "vec_id", "embedding", "label")
    got = sorted([(r.vec_id, r.code, r.error, r.label_error) for r in coded.collect()], key=str)
    exact = [(i, v if v is None or kind == "double" else [None if x is None else float(np.float32(x)) for x in v], g) for i, v, g in rows]
    want, digest = brute(exact)
    assert got == want
    assert vector_codes.digest(books) == digest
    return coded, books


def vectors(n, width, seed, spread=1.0):
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, spread) for _ in range(width)] for _ in range(6)]
    return [(i * 3 - 50, [c + rnd.gauss(0, spread / 5) for c in rnd.choice(centres)], rnd.choice([None, 1, 2, 2, 2])) for i in range(n)]


def test_rows_against_brute_force(spark):
    rows = vectors(400, 8, 1)
    rows += [(5000, None, 1), (5001, [None] + [0.0] * 7, 1), (5002, [float("nan")] * 8, 1), (5003, [float("inf")] + [0.0] * 7, 2), (5004, [0.0] * 8, None), (-999, [-0.0001] * 8, 2)]
    rows += [rows[3], rows[3], (None, rows[5][1], 7), (None, rows[5][1], 7)]
    check(spark, rows)


def test_ties_go_to_the_lower_index(spark):
    """Points on a coarse lattice, with many equal entries and equal distances."""
    rnd = random.Random(2)
    check(spark, [(i, [rnd.choice([0, 2, 4]) / 1024 for _ in range(8)], i % 3) for i in range(500)])


def test_few_rows_and_empty_table(spark):
    check(spark, vectors(3, 4, 3))
    coded, books = vector_codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label")
    assert coded.collect() == [] and books == []
    coded, books = vector_codes.compress(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"), "vec_id", "embedding", "label")
    assert coded.collect() == [] and books == []


def test_large_integers_are_exact(spark):
    check(spark, vectors(300, 8, 4, 1e6), "double")


def test_other_lengths_are_left_out(spark):
    rows = vectors(30, 8, 5)
    frame = spark.createDataFrame(rows + [(9000, [1.0] * 4, 1), (9001, [], 1)], "vec_id long, embedding array<double>, label int")
    assert vector_codes.compress(frame, "vec_id", "embedding", "label")[0].count() == 30


def test_tree_finds_the_nearest_and_lowest():
    rnd = np.random.default_rng(3)
    for high in (3, 1000):
        entries, points = rnd.integers(-high, high, (200, 5)), rnd.integers(-high, high, (700, 5))
        index, far = vector_codes.nearest(vector_codes.kd_tree(entries), points)
        every = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (far == every.min(1)).all()
        wide = vector_codes.nearest(vector_codes.kd_tree(entries.astype(object)), points.astype(object))
        assert (wide[0] == index).all() and (wide[1] == far).all()


def test_decoded_vectors_are_near(spark):
    rows = vectors(300, 8, 6)
    coded, books = vector_codes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), "vec_id", "embedding", "label")
    by_id = {i: v for i, v, _ in rows}
    for r in coded.withColumn("back", vector_codes.decoded("code", books)).collect():
        ints = [math.floor(1024 * x) for x in by_id[r.vec_id]]
        assert sum((int(b * 1024) - x) ** 2 for b, x in zip(r.back, ints, strict=True)) == r.error
