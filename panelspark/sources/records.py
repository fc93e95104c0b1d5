"""CSV records with their places, of files that many tasks read: quoted fields may hold line ends, also across splits.

Each split of a file counts its quotes, and the records that begin in it for both states that it may begin in, inside
quotes or outside. A scan over the splits of each file settles the states and the numbers of the first records; then the
splits are read again, each on its own, for whole records and for pieces. Only records that cross a split are put together
by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import ContractError
from ..held import hold

#: The table of splits, a row of some 150 bytes for each, is broadcast up to so many: 128 TB in splits of 128 MB.
SPLITS = 1_000_000
#: Where splits are small a task takes several: up to TASK bytes, or a share of all for each of WAVES tasks a core.
TASK, WAVES = 128 << 20, 4


def listing(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` in which folders are listed by a few tasks for each core, not one for each folder."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.sources.parallelPartitionDiscovery.parallelism", str(WAVES * spark.sparkContext.defaultParallelism))
    return own


def _reading(spark: SparkSession, path: str, split_bytes: int | None) -> SparkSession:
    """A session like ``spark`` in which files are cut into the same splits whatever executors there are, as they are read twice.

    Splits are dealt out to no more tasks than TASK and WAVES ask for, as a task's start costs more than a small split.
    """
    own = listing(spark)
    total = own.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0] or 0
    size = str(split_bytes or spark.conf.get("spark.sql.files.maxPartitionBytes"))
    own.conf.set("spark.sql.files.maxPartitionBytes", size)
    own.conf.set("spark.sql.files.openCostInBytes", size)  # so the size of splits doesn't follow the number of cores
    own.conf.set("spark.sql.files.maxPartitionNum", str(max(-(-total // TASK), WAVES * spark.sparkContext.defaultParallelism)))
    return own


def _runs(key: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    cuts = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if len(key) else []


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each split: whether its quotes are odd, and how many records begin in it for each state at its start."""
    kind = pa.schema({"file": pa.string(), "block": pa.int64(), "odd": pa.bool_(), "begun_out": pa.int64(), "begun_in": pa.int64()})
    at, quotes, begun = None, 0, [0, 0]

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": at[0], "block": at[1], "odd": bool(quotes & 1), "begun_out": begun[0], "begun_in": begun[1]}], kind)

    for b in batches:
        files = b.column("file").dictionary_encode()
        blocks, q, blank = b.column("block").to_numpy(), b.column("quotes").to_numpy(), b.column("blank").to_numpy(zero_copy_only=False)
        codes = files.indices.to_numpy().astype("i8")
        for lo, hi in _runs(codes * (int(blocks.max(initial=0)) + 1) + blocks):
            here = (files.dictionary[int(codes[lo])].as_py(), int(blocks[lo]))
            if here != at:
                if at is not None:
                    yield row()
                at, quotes, begun = here, 0, [0, 0]
            inside = (quotes + np.cumsum(q[lo:hi]) - q[lo:hi]) & 1
            for state in (0, 1):
                begun[state] += int(np.count_nonzero(~blank[lo:hi] & (inside == state)))
            quotes += int(q[lo:hi].sum())
    if at is not None:
        yield row()


_RECORD = pa.schema({"split": pa.int64(), "number": pa.int64(), "crosses": pa.bool_(), "text": pa.string()})


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of each split with their numbers in the file; pieces of those that cross its bounds are marked."""
    at, inside, number, pieces, leading = None, 0, 0, [], False

    def rows(numbers, texts, crosses) -> pa.RecordBatch:
        n = len(numbers)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, at), pa.int64()), pa.array(numbers, pa.int64()), pa.array(np.full(n, crosses), pa.bool_()), texts], schema=_RECORD)

    for b in batches:
        if b.column("split").null_count:
            raise ContractError("the files were cut into other splits than when their records were counted: they changed meanwhile")
        splits, q, blank = b.column("split").to_numpy(), b.column("quotes").to_numpy(), b.column("blank").to_numpy(zero_copy_only=False)
        for lo, hi in _runs(splits):
            if splits[lo] != at:
                if pieces:
                    yield rows([number], pa.array(["\n".join(pieces)], pa.string()), True)
                at, number = int(splits[lo]), b.column("before")[lo].as_py()
                inside, pieces = int(b.column("inside")[lo].as_py()), []
                leading = bool(inside)
            lines = b.column("line").slice(lo, hi - lo)
            after = (inside + np.cumsum(q[lo:hi])) & 1
            within = np.concatenate([[inside], after[:-1]])
            begins = ~blank[lo:hi] & (within == 0)
            numbers = number + np.cumsum(begins)
            kept = np.flatnonzero(begins | (within == 1))
            first, held_lines = np.flatnonzero(begins[kept]), lines.take(pa.array(kept))
            head = int(first[0]) if len(first) else len(kept)  # lines of the record that was open before
            if head:
                pieces += held_lines[:head].to_pylist()
                if after[kept[head - 1]] == 0:
                    yield rows([number], pa.array(["\n".join(pieces)], pa.string()), leading)
                    pieces, leading = [], False
            if len(first) and after[-1]:  # the last one goes on
                pieces, first, end = held_lines[int(first[-1]) :].to_pylist(), first[:-1], int(first[-1])
            else:
                end = len(kept)
            if len(first):
                together = pa.ListArray.from_arrays(pa.array([*first.tolist(), end], pa.int32()), held_lines)
                yield rows(numbers[kept[first]], pc.binary_join(together, "\n"), False)
            inside, number = int(after[-1]), int(numbers[-1])
    if pieces:
        yield rows([number], pa.array(["\n".join(pieces)], pa.string()), True)


def read_records(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Records (source_file, source_row, text) of CSV files: a record's place is exact, however its file is cut into splits.

    Fields may be quoted with doubled quotes inside; a quote stands in quoted fields only. Lines end in \\n or \\r\\n; empty
    lines outside quotes are no records. A quote that is never closed ends with its file. Text is held as it is, without the
    last line end; no file or no record gives no row. Packed files can't be cut, so each is one task's. ``split_bytes``
    replaces the session's split size. The result belongs to a session of its own with the same settings.
    """
    own = _reading(spark, path, split_bytes)
    lines = own.read.text(path, lineSep="\n").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("line"))
    lines = lines.withColumns({"quotes": (F.length("line") - F.length(F.replace("line", F.lit('"')))).cast("long"), "blank": F.col("line").isin("", "\r")})
    counted = lines.drop("line").mapInArrow(_count, "file string, block long, odd boolean, begun_out long, begun_in long")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split of a file
    settled = counted.withColumn("inside", F.coalesce(F.sum(F.col("odd").cast("int")).over(before), F.lit(0)) % 2 == 1)
    settled = settled.withColumn("before", F.coalesce(F.sum(F.when(F.col("inside"), F.col("begun_in")).otherwise(F.col("begun_out"))).over(before), F.lit(0)))
    splits = hold(settled.select(F.monotonically_increasing_id().alias("split"), "file", "block", "inside", "before"))
    if splits.count() > SPLITS:
        raise ContractError(f"more than {SPLITS} splits: give larger split_bytes")
    found = lines.join(F.broadcast(splits), ["file", "block"], "left").select("split", "before", "inside", "quotes", "blank", "line")
    records = found.mapInArrow(_records, "split long, number long, crosses boolean, text string")
    records = records.join(F.broadcast(splits.select("split", "file", "block")), "split")
    pieces = records.filter("crosses").groupBy("file", "number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "text"))), lambda p: p["text"]), "\n").alias("text"))
    name = F.url_decode(F.replace(F.element_at(F.split("file", "/"), -1), F.lit("+"), F.lit("%2B")))  # paths come escaped, but for the plus sign
    shown = [name.alias("source_file"), F.col("number").alias("source_row"), F.expr("if(endswith(text, '\\r'), left(text, length(text) - 1), text)").alias("text")]
    return records.filter("not crosses").select(*shown).unionByName(pieces.select(*shown))
