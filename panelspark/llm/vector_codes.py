"""Compression of vectors to one byte a part: codebooks by rounds of nearest entries and integer means.

Vectors become integers, floor(SCALE * x), and are cut into PARTS consecutive parts; each part position has a codebook
of ENTRIES entries at most. A round broadcasts a kd-tree for each codebook, finds every part's nearest entry in the tasks,
and adds up counts and sums of components by entry; Spark sums what tasks found, and only the new entries come to the driver
(PARTS * ENTRIES rows, whatever the input). All arithmetic is on integers, so results don't depend on how rows are dealt out.

The search goes down a tree for all vectors of a batch at once: each vector to the nearer side first, then to
the other one if that side's box is no farther than the best entry so far. Boxes that are just as far are visited too, as an
entry with a lower index may tie there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Entries of a leaf; vectors that are searched together.
LEAF, TOGETHER = 8, 4096
#: Integers below this take 64-bit arithmetic (squared distances of wide vectors fit); others Python's own.
NARROW = 1 << 27
#: Components of this size or more have no integer here and count as not finite.
TOO_LARGE = float(1 << 52)
LONG_MAX = (1 << 63) - 1


@dataclass
class Node:
    """A box around some entries: two halves of it, or a leaf with the entries' indexes in ascending order."""

    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray
    at: np.ndarray | None = None
    axis: int = 0
    cut: int = 0
    left: Node | None = None
    right: Node | None = None


def kd_tree(entries: np.ndarray, at: np.ndarray | None = None) -> Node:
    """Halves boxes at the median of their widest axis."""
    at = np.arange(len(entries)) if at is None else at
    own = entries[at]
    low, high = own.min(0), own.max(0)
    if len(at) <= LEAF or not len(low) or (low == high).all():
        return Node(low, high, own, at)
    axis = int(np.argmax(high - low))
    middle = np.sort(own[:, axis])[len(at) // 2]
    cut = middle if middle > low[axis] else own[:, axis][own[:, axis] > middle].min()
    below = own[:, axis] < cut
    return Node(low, high, own, None, axis, cut, kd_tree(entries, at[below]), kd_tree(entries, at[~below]))


def nearest(tree: Node, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each point's nearest entry (the lowest of equals) and its squared distance."""
    wide = points.dtype == object or tree.low.dtype == object
    best = np.full(len(points), 1 << 200 if wide else LONG_MAX, object if wide else "i8")
    index = np.full(len(points), -1)

    def visit(node: Node, rows: np.ndarray) -> None:
        out = np.maximum(np.maximum(node.low - points[rows], points[rows] - node.high), 0)
        rows = rows[(out * out).sum(1) <= best[rows]]
        if not len(rows):
            return
        if node.at is not None:
            apart = points[rows][:, None, :] - node.entries[None]
            far = (apart * apart).sum(2)
            k = far.argmin(1)
            far, found = far[np.arange(len(rows)), k], node.at[k]
            better = (far < best[rows]) | ((far == best[rows]) & (found < index[rows]))
            best[rows[better]], index[rows[better]] = far[better], found[better]
            return
        below = points[rows, node.axis] < node.cut
        visit(node.left, rows[below])
        visit(node.right, rows[~below])
        visit(node.right, rows[below])
        visit(node.left, rows[~below])

    if len(points):
        visit(tree, np.arange(len(points)))
    return index, best


def cut_parts(points: np.ndarray, parts: int) -> list[np.ndarray]:
    """Consecutive parts of equal width; of a width that can't be cut so, the first ones are wider by one."""
    return np.array_split(points, parts, axis=1)


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    flat = values.flatten().to_numpy(zero_copy_only=False).astype("i8").reshape(len(values), width)
    return flat if not flat.size or np.abs(flat).max() < NARROW else flat.astype(object)


def integers(vectors: DataFrame, vec_id: str, embedding: str, scale: int = SCALE) -> DataFrame:
    """Adds ``__ints``: the vectors' integers. Rows whose vector is null or holds null, non-finite or too large components are left out.

    So are vectors of another length than that of the least kept id (null ids are last, and equal ids are ordered by their
    integers): the parts of a codebook have one width.
    """
    x = F.col(embedding).cast("array<double>")
    right = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < TOO_LARGE))
    kept = vectors.filter(F.col(embedding).isNotNull()).filter(right).withColumn("__ints", F.transform(x, lambda c: F.floor(c * scale)))
    first = kept.orderBy(F.col(vec_id).asc_nulls_last(), "__ints").select(F.size("__ints")).first()
    return kept.filter(F.size("__ints") == (first[0] if first else 0))


def train(rows: DataFrame, vec_id: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebooks for rows of ``integers``, which are read once a round: give a written table.

    They start as the parts of the ``entries`` least ids' vectors. In a round every part goes to the nearest entry, and an entry becomes its parts'
    sum divided by their number, rounded down; entries without any stay. Only ``entries`` vectors and, in a
    round, sums by part, entry and component come to the driver.
    """
    first = rows.orderBy(F.col(vec_id).asc_nulls_last(), "__ints").select("__ints").limit(entries).collect()
    if not first:
        return []
    start = np.array([r[0] for r in first], object).reshape(len(first), -1)
    width, books = start.shape[1], [_narrow(b) for b in cut_parts(start, parts)]
    context = rows.sparkSession.sparkContext
    for _ in range(rounds):
        trees = context.broadcast([kd_tree(b) for b in books])
        sizes = [b.shape for b in books]

        def add(batches: Iterator[pa.RecordBatch], trees=trees, sizes=sizes) -> Iterator[pa.RecordBatch]:
            sums, counts = [np.zeros(s, object) for s in sizes], [np.zeros(s[0], "i8") for s in sizes]
            for batch in batches:
                whole = _matrix(batch.column(0), width)
                for at in range(0, len(whole), TOGETHER):
                    for p, points in enumerate(cut_parts(whole[at : at + TOGETHER], len(sizes))):
                        index, _ = nearest(trees.value[p], points)
                        here = np.zeros(sizes[p], points.dtype)
                        np.add.at(here, index, points)
                        sums[p] += here
                        counts[p] += np.bincount(index, minlength=sizes[p][0])
            for p, n in enumerate(counts):
                for k in np.flatnonzero(n).tolist():
                    yield pa.RecordBatch.from_pylist([{"part": p, "entry": k, "place": j, "total": str(v)} for j, v in enumerate([int(n[k]), *sums[p][k].tolist()])], schema)

        schema = pa.schema({"part": pa.int32(), "entry": pa.int32(), "place": pa.int32(), "total": pa.string()})
        found = rows.select("__ints").mapInArrow(add, "part int, entry int, place int, total string").groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        totals = {(r.part, r.entry, r.place): int(r.total) for r in found.collect()}  # entries * (width + parts) rows at most
        trees.unpersist()
        new = [b.astype(object) for b in books]
        for (p, k, place), total in totals.items():
            if place:
                new[p][k, place - 1] = total // totals[p, k, 0]
        books = [_narrow(b) for b in new]
    return books


def _narrow(book: np.ndarray) -> np.ndarray:
    return book.astype("i8") if not book.size or max(abs(int(book.max())), abs(int(book.min()))) < NARROW else book


def codes(ints: str | Column, books: list[np.ndarray], spark: SparkSession) -> Column:
    """Struct of ``code`` (two hexadecimal digits for each part) and ``error`` (squared distances, summed; at most the greatest long)."""
    trees = spark.sparkContext.broadcast([kd_tree(b) for b in books])
    width = sum(b.shape[1] for b in books)

    def code(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            whole = _matrix(batch, width)
            found = [nearest(t, x) for t, x in zip(trees.value, cut_parts(whole, len(trees.value)), strict=True)]
            text = [bytes(row).hex() for row in np.stack([i for i, _ in found], 1).astype("u1")] if len(whole) else []
            error = [min(int(sum(e)), LONG_MAX) for e in zip(*(d.tolist() for _, d in found), strict=True)]
            yield pa.StructArray.from_arrays([pa.array(text, pa.string()), pa.array(error, pa.int64())], ["code", "error"])

    return F.arrow_udf(code, "code string, error long")(F.col(ints) if isinstance(ints, str) else ints)


def decoded(code: str | Column, books: list[np.ndarray], scale: int = SCALE) -> Column:
    """The vector that a code stands for: its entries' components divided by ``scale``."""

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if c is None else [int(v) / scale for b, k in zip(books, bytes.fromhex(c), strict=True) for v in b[k]] for c in batch.to_pylist()], pa.list_(pa.float64()))

    return F.arrow_udf(decode, "array<double>")(F.col(code) if isinstance(code, str) else code)


def digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' decimal components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def compress(vectors: DataFrame, vec_id: str, embedding: str, label: str) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows of ``vec_id``, ``label``, ``code``, ``error``, ``label_error``; the codebooks).

    Rows that ``integers`` leaves out don't come back; repeated rows and ids do, each. ``label_error`` is the sum of errors over equal
    labels, nulls together. Of labels with very many rows no task gets all. Other columns are not read. Without any
    kept row, there are no rows and no codebooks.
    """
    spark = vectors.sparkSession
    source = vectors.select(F.col(vec_id).alias("id"), F.col(embedding).alias("vec"), F.col(label).alias("label"))
    with common.scratch(spark) as keep:
        rows, _ = common.written(integers(source, "id", "vec").select("id", "label", "__ints"), "vectors")
        books = train(rows, "id")
        coded = rows.withColumn("c", codes("__ints", books, spark)) if books else rows.withColumn("c", F.lit(None).cast("struct<code: string, error: long>"))
        out, path = common.written(coded.select("id", "label", F.col("label").cast("string").alias("__label"), "c.code", "c.error").fillna("", ["__label"]).withColumn("__none", F.col("label").isNull()), "codes")
        keep(path)
        joined = F.struct("__none", "__label")
        sums = out.groupBy(joined.alias("__key")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("e"), F.count("*").alias("n"))
        sums, path = common.written(sums.withColumn("label_error", F.least(F.col("e"), F.lit(LONG_MAX).cast("decimal(38,0)")).cast("long")).drop("e"), "label-errors")
        keep(path)
        total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    whole = common.spread_join(out.withColumn("__key", joined), sums, "__key", "n", total)
    return whole.select(F.col("id").alias(vec_id), F.col("label").alias(label), "code", "error", "label_error"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(common.table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label")
    return coded.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round(k: int) -> str:
    """SQL of one round: nearest entries of the codebook b<k>, and the codebook after it."""
    return f"""
n{k} AS MATERIALIZED (
  SELECT vec_id, p, arg_min(i, d * 256 + i) AS i, min(d) AS d FROM (
    SELECT vec_id, x.p, i, CAST(list_sum(list_transform(range(1, len(v) + 1), lambda j: (v[j] - c[j]) * (v[j] - c[j]))) AS BIGINT) AS d
    FROM parts x JOIN b{k} USING (p)) GROUP BY vec_id, p),
m{k} AS (
  SELECT p, i, j, CAST(floor(sum(v[j]) / count(*)) AS BIGINT) AS x
  FROM (SELECT n.p, n.i, v, unnest(range(1, len(v) + 1)) AS j FROM n{k} n JOIN parts USING (vec_id, p)) GROUP BY p, i, j),
b{k + 1} AS MATERIALIZED (
  SELECT b.p, b.i, coalesce(l.c, b.c) AS c FROM b{k} b LEFT JOIN (SELECT p, i, list(x ORDER BY j) AS c FROM m{k} GROUP BY p, i) l USING (p, i))"""


#: Every part against every entry, for each round.
ORACLE_SQL = {
    "op13_vector_codes": rf"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, v[p * (len(v) // 4) + 1 : (p + 1) * (len(v) // 4)] AS v FROM kept, range(0, 4) r(p)),
b0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS i, v AS c
  FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256)),
{",".join(_round(k) for k in range(5))},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, i)) AS s FROM b4),
coded AS (SELECT vec_id, string_agg(printf('%02x', i), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n4 GROUP BY vec_id),
labelled AS (SELECT coded.*, label FROM coded JOIN kept USING (vec_id))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, s AS codebooks_sha256 FROM labelled, books
"""
}
QUERIES = {"op13_vector_codes": op13_vector_codes}
