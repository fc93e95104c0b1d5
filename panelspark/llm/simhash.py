"""SimHash near-duplicates: fingerprints, all links within a few bits, connected components.

Links are found by a range join on a grid. Each fingerprint is embedded as the bit counts of its
32 two-bit segments; the Manhattan distance of two such vectors never exceeds the number of bits
in which the fingerprints differ. The dimensions form six blocks. Two vectors within distance 3
agree exactly on three blocks at least, so each vector is filed under the 20 grid cells that its
triples of blocks name, and vectors that share a cell are compared: first by the Manhattan bound,
then exactly.

A count in a segment is kept in unary (0: 00, 1: 01, 2: 11), so that a vector is one long and the
Manhattan distance is the number of differing bits of two such longs.

Equal fingerprints are one node. With very many nodes the grid is a finer one (eight blocks, of which
five agree). A cell with too many nodes (close variants of one text) is not joined: its nodes go on to
cells of exact bits (five of eight bytes), and nodes of cells that are crowded even then are linked by
stars. Each of these reports to all points within two bits of it; of two linked nodes, one is then within one bit of a
point within two bits of the other. At a point, nodes within one bit link to all that report there, so a
star around the least of them holds these links. A node makes 2081 such rows at most, a point gets 2081 at most,
and no pairs of a crowd are made. No step makes more than a fixed number of rows for each node.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Fingerprints that differ in so many bits or fewer are linked.
LINK_BITS = 3
#: Nodes of a cell that are compared pair by pair; a fuller cell is split further.
CELL_NODES = 64
SEED = 42
_BITS = np.array([[v >> b & 1 for b in range(8)] for v in range(256)], "i8")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(bits) -> int:
    return sum(1 << b for b in bits)


def _choices(blocks: list[range], same: int) -> list[int]:
    """Masks of the bits that each choice of ``same`` blocks covers."""
    return [_mask(b for block in some for b in block) for some in combinations(blocks, same)]


GRID = _choices([range(0, 12), range(12, 22), range(22, 32), range(32, 44), range(44, 54), range(54, 64)], 3)
BYTES = _choices([range(k, k + 8) for k in range(0, 64, 8)], 5)
#: Nodes up to which the grid of six blocks is taken, whose cells tell some 2 ** 24 places apart; that of eight tells 2 ** 30.
GRID_NODES = 1 << 27
#: Differences of one bit and of two.
NEAR = [0, *(1 << b for b in range(64))]
BESIDE = [1 << a | 1 << b for a, b in combinations(range(64), 2)]


def fingerprint(text: str) -> int:
    """SimHash of the three-word shingles of one text, as a signed 64-bit number; 0 without words."""
    words = text.encode().lower().split()  # on bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), "i8", len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(3, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    columns = np.array(hashes, "<u8").view("u1").reshape(-1, 8)
    counts = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in texts:
        yield pa.array([fingerprint(x or "") for x in batch.to_pylist()], pa.int64())


def _cells(nodes: DataFrame, key: Column, masks: list[int]) -> DataFrame:
    masks_of = F.array(*(F.lit(_signed(m)) for m in masks))
    return nodes.select("fp", F.posexplode(masks_of).alias("choice", "mask")).select("fp", "choice", key.bitwiseAND(F.col("mask")).alias("cell"))


def _differ(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def embedding(fp: Column) -> Column:
    """Bit counts of the two-bit segments, in unary."""
    low = F.lit(0x5555555555555555)
    half = F.shiftrightunsigned(fp, 1)
    return fp.bitwiseOR(half).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(half).bitwiseAND(low), 1))


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b), a < b, that connect all and only what links of distinct fingerprints ``fp`` connect."""
    found: list[DataFrame] = []
    fine = nodes.count() > GRID_NODES
    for what, masks in (("grid", BYTES if fine else GRID), ("bytes", BYTES)):
        key = embedding(F.col("fp")) if what == "grid" else F.col("fp")
        cells = _cells(nodes, key, masks)
        sizes, _ = common.written(cells.groupBy("choice", "cell").agg(F.count("*").alias("n")).filter("n > 1"), f"cells-{what}")
        members, _ = common.written(cells.join(sizes.filter(F.col("n") <= CELL_NODES), ["choice", "cell"]).drop("n"), f"members-{what}")
        a, b = members.withColumnRenamed("fp", "a"), members.withColumnRenamed("fp", "b")
        near = F.col("a") < F.col("b")
        if what == "grid":
            bound = F.bit_count(embedding(F.col("a")).bitwiseXOR(embedding(F.col("b"))))
            near &= bound <= LINK_BITS
        pairs = a.join(b, ["choice", "cell"]).filter(near & (_differ("a", "b") <= LINK_BITS)).select("a", "b")
        found.append(pairs)
        crowded = sizes.filter(F.col("n") > CELL_NODES)
        if crowded.isEmpty():
            break
        nodes, _ = common.written(cells.join(crowded.drop("n"), ["choice", "cell"]).select("fp").distinct(), f"crowded-{what}")
    else:
        found.append(_stars(nodes))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _stars(crowded: DataFrame) -> DataFrame:
    """Links of nodes within three bits, as stars: at each point, its reporters and the least of those within one bit."""
    masks = F.from_json(F.lit(json.dumps([_signed(m) for m in NEAR + BESIDE])), "array<long>")
    reports = crowded.select("fp", F.posexplode(masks).alias("k", "mask")).select("fp", (F.col("k") < len(NEAR)).alias("near"), F.col("fp").bitwiseXOR(F.col("mask")).alias("point"))
    points = reports.groupBy("point").agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("centre"), F.collect_list("fp").alias("all"))  # NEAR + BESIDE at most
    star = points.filter("centre IS NOT NULL AND size(all) > 1").select("centre", F.explode("all").alias("fp")).filter("centre <> fp")
    return star.select(F.least("centre", "fp").alias("a"), F.greatest("centre", "fp").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node with an edge (a, b); the root is the least node of the component.

    Alternates large stars (each node's greater neighbours move to its least neighbour) and small stars
    (its lesser ones do) until nothing changes. Each round is written to the shared folder.
    """
    spark = edges.sparkSession
    star, path = common.written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    before, total = None, star.count()
    while True:
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        large = common.spread_join(both.filter("v > u"), least, "u", "n", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = common.spread_join(large, least, "u", "n", total)
        moved = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        star, new = common.written(moved.filter("u <> v").distinct(), "edges")
        common.remove(spark, path)
        path = new
        now = star.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before:
            return star.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, total = now, now[0]


def _row_key(doc_id: str, text: str) -> Column:
    return F.md5(F.concat_ws("\x00", F.coalesce(F.col(doc_id).cast("string"), F.lit("\x01")), common.text_or_empty(text)))


def near_duplicates(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row for each row of ``docs``: its id, ``row_key`` (a digest of id and text), ``fp`` (signed long), ``root`` and ``component_id``.

    ``component_id`` is the least id that links reach, itself included; null ids never count as least, and
    a component of null ids has null. A null or blank text has fingerprint 0, which is linked like any
    other. Repeated rows stay, with equal results. Other columns are not read.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    udf = F.arrow_udf(fingerprints, "long")
    with common.scratch(spark) as keep:
        each, path = common.written(docs.select(F.col(doc_id).alias("id"), _row_key(doc_id, text).alias("row_key"), udf(F.col(text)).alias("fp")), "fingerprints")
        keep(path)
        nodes, _ = common.written(each.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("n")), "nodes")
        roots = components(links(nodes.select("fp")))
        rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root"))
        rooted, _ = common.written(rooted, "rooted")
        total = rooted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        of_root = rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"))
        of_fp, path = common.written(common.spread_join(rooted, of_root, "root", "m", total), "components")
        keep(path)
    return common.spread_join(each, of_fp.select("fp", "root", "component_id", "n"), "fp", "n", total).select(F.col("id").alias(doc_id), "row_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component, the row with the least id stays.

    Rows with a null id rank last; of rows that repeat both id and text, the one whose other columns have the least hash
    stays. All columns are kept.
    """
    spark, key, rest = docs.sparkSession, common.free_name(docs, "__row_key"), [c for c in docs.columns if c not in (doc_id, text)]
    with common.scratch(spark) as keep:
        found = near_duplicates(docs, doc_id, text)
        first = F.min(F.struct(F.col(doc_id).isNull(), F.col(doc_id), "row_key"))
        stay, path = common.written(found.groupBy("root").agg(first.alias("x")).select(F.col("x.row_key").alias(key)), "stay")
        keep(path)
    kept = docs.withColumn(key, _row_key(doc_id, text)).join(stay, key, "left_semi")
    others = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in rest)))) if rest else F.lit(0)
    return kept.groupBy(key).agg(F.min_by(F.struct(*(F.col(f"`{c}`") for c in docs.columns)), others).alias("row")).select("row.*")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op7_simhash_dedup": op7_simhash_dedup}
