"""A ZIP archive of tables as CSV, with the same bytes in every run, that tasks pack in pieces and put in place.

Rows get canonical places first, so a piece is the same rows however the table is partitioned. Each is deflated on its own and
ends at a byte; pieces of a member follow one another, its sum is combined from theirs, and the directory is written last.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
import zlib
from functools import reduce
from urllib.parse import unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..contracts import ContractError
from ..held import hold, shared_dir

#: Lines of a piece, which one task packs, and the level of packing: both are part of the bytes.
PIECE_ROWS, LEVEL = 50_000, 6
#: Fixed values of the format: signatures, version 4.5 for 64-bit sizes, deflate, names in UTF-8, the day 1980-01-01.
LOCAL, ENTRY, END64, LOCATOR, END = 0x04034B50, 0x02014B50, 0x06064B50, 0x07064B50, 0x06054B50
VERSION, DEFLATE, UTF8, DAY, FULL32, FULL16 = 45, 8, 0x800, 0x21, 0xFFFFFFFF, 0xFFFF
#: An empty last block, which ends a member's stream.
LAST_BLOCK = b"\x03\x00"


def packed(data: bytes) -> bytes:
    coder = zlib.compressobj(LEVEL, zlib.DEFLATED, -15)
    return coder.compress(data) + coder.flush(zlib.Z_FULL_FLUSH)


def combined_crc(first: int, second: int, length: int) -> int:
    """CRC-32 of two strings in a row from theirs and the second one's length."""
    times = lambda m, v: reduce(lambda x, i: x ^ m[i] if v >> i & 1 else x, range(32), 0)
    step = [zlib.crc32(b"\0", (1 << i) ^ FULL32) ^ FULL32 for i in range(32)]  # what a zero byte makes of each bit
    while length:
        if length & 1:
            first = times(step, first)
        step, length = [times(step, column) for column in step], length >> 1
    return first ^ second


def _local(name: bytes, crc: int, raw: int, size: int) -> bytes:
    extra = struct.pack("<HHQQ", 1, 16, raw, size)
    return struct.pack("<IHHHHHIIIHH", LOCAL, VERSION, UTF8, DEFLATE, 0, DAY, crc, FULL32, FULL32, len(name), len(extra)) + name + extra


def _directory(members: list[tuple[bytes, int, int, int, int]]) -> bytes:
    """The entries (name, sum, bytes, packed bytes, offset) and what closes the archive; the directory's own offset is where the last member ends."""
    out = b""
    for name, crc, raw, size, at in members:
        extra = struct.pack("<HHQQQ", 1, 24, raw, size, at)
        out += struct.pack("<IHHHHHHIIIHHHHHII", ENTRY, VERSION, VERSION, UTF8, DEFLATE, 0, DAY, crc, FULL32, FULL32, len(name), len(extra), 0, 0, 0, 0, FULL32) + name + extra
    begin = sum(len(_local(*m[:4])) + m[3] for m in members)
    n, size = len(members), len(out)
    out += struct.pack("<IQHHIIQQQQ", END64, 44, VERSION, VERSION, 0, 0, n, n, size, begin)
    out += struct.pack("<IIQI", LOCATOR, 0, begin + size, 1)
    return out + struct.pack("<IHHHHIIH", END, 0, 0, min(n, FULL16), min(n, FULL16), FULL32, FULL32, 0)


def _lines(df: DataFrame, order: list[str]) -> DataFrame:
    """(line, place): rows as CSV, numbered in the order of columns and, among ties, of their text."""
    text = F.to_csv(F.struct(*df.columns), {"escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    keys = [F.col(f"k{i}") for i in range(len(order))] + [F.col("line")]
    rows = df.select(*(F.col(c).alias(f"k{i}") for i, c in enumerate(order)), text.alias("line")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    held = hold(rows.select("line", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("id")))
    sizes = held.groupBy("part").agg(F.count("*").alias("n"), F.min("id").alias("first"))  # a row for each task
    before = sizes.select("part", "first", (F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")).alias("before"))
    return held.join(F.broadcast(before), "part").select("line", (F.col("before") + F.col("id") - F.col("first")).alias("place"))


def write_archive(spark: SparkSession, tables: dict[str, DataFrame], path: str, order: dict[str, list[str]] | None = None, folder: str = "") -> DataFrame:
    """Write each table as member ``folder/name.csv`` of the ZIP file ``path``, which appears once it is complete.

    Rows stand in the order of the columns named (nulls first), ties in that of their text; an empty table is its header. Returns
    the manifest: name, n_rows, n_bytes, n_packed, crc32, sha256 of each member. The same tables give the same bytes however they
    are partitioned. ``path`` is in a folder that driver and executors share as files, since tasks write at places of one file;
    tables' names are the archive's contents, so a list on the driver. A member's SHA-256 is sequential: one task reads its pieces in turn.
    """
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ContractError("an archive is written at places of one file, which needs a folder shared as files")
    target = unquote(url.path) if url.scheme else path
    base = urlparse(shared_dir(spark))
    if base.scheme not in ("", "file"):
        raise ContractError("pieces need a shared folder of files")
    work = os.path.join(unquote(base.path), f"pieces-{uuid.uuid4().hex}")
    names, heads = list(tables), {}
    os.makedirs(work)
    pieces = []
    for k, name in enumerate(names):
        lines = _lines(tables[name], (order or {}).get(name, []))
        pieces.append(lines.select(F.lit(k).alias("member"), F.floor(F.col("place") / PIECE_ROWS).alias("piece"), "place", "line"))
        heads[k] = (spark.range(1).select(F.to_csv(F.struct(*(F.lit(c).alias(f"c{i}") for i, c in enumerate(tables[name].columns))), {"escape": '"'})).first()[0] + "\n").encode()

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        k, piece = int(rows["member"].iloc[0]), int(rows["piece"].iloc[0])
        data = "".join(x + "\n" for x in rows.sort_values("place")["line"]).encode()
        out, at = packed(data), os.path.join(work, f"{k}-{piece}")
        with open(f"{at}.{uuid.uuid4().hex}", "wb") as f:
            f.write(out)
        os.replace(f.name, at)
        return pd.DataFrame([(k, piece, len(rows), len(data), len(out), zlib.crc32(data))], columns=["member", "piece", "n_rows", "raw", "size", "crc"])

    kind = "member int, piece long, n_rows long, raw long, size long, crc long"
    done = hold(reduce(DataFrame.unionByName, pieces).groupBy("member", "piece").applyInPandas(pack, kind))

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        rows, k = rows.sort_values("piece"), int(rows["member"].iloc[0])
        crc, sha = zlib.crc32(heads[k]), hashlib.sha256(heads[k])
        for r in rows[rows["piece"] >= 0].itertuples():
            crc = combined_crc(crc, int(r.crc), int(r.raw))
            with open(os.path.join(work, f"{k}-{r.piece}"), "rb") as f:
                sha.update(zlib.decompressobj(-15).decompress(f.read()))
        head = packed(heads[k])
        return pd.DataFrame([(k, rows["n_rows"].sum(), len(heads[k]) + rows["raw"].sum(), len(head) + rows["size"].sum() + len(LAST_BLOCK), crc, sha.hexdigest())], columns=["member", "n_rows", "n_bytes", "n_packed", "crc32", "sha256"])

    begun = spark.createDataFrame([(k, -1, 0, 0, 0, 0) for k in heads], kind)  # so an empty table has a row, too
    found = hold(done.unionByName(begun).groupBy("member").applyInPandas(whole, "member int, n_rows long, n_bytes long, n_packed long, crc32 long, sha256 string"))
    members, at, starts = [], 0, {}
    for r in sorted(found.collect()):  # a row for each table
        name = f"{folder.rstrip('/')}/{names[r.member]}.csv".lstrip("/").encode()
        members.append((name, r.crc32, r.n_bytes, r.n_packed, at))
        starts[r.member] = at + len(_local(*members[-1][:4]))
        at = starts[r.member] + r.n_packed
    staged = f"{target}.{uuid.uuid4().hex}"
    with open(staged, "wb") as f:
        for k, m in enumerate(members):
            f.seek(m[4])
            f.write(_local(*m[:4]) + packed(heads[k]))
            f.seek(starts[k] + m[3] - len(LAST_BLOCK))
            f.write(LAST_BLOCK)
        f.write(_directory(members))

    def put(frames):
        for one in frames:
            with open(staged, "r+b") as out:  # writing again after a lost executor changes nothing
                for r in one.itertuples():
                    out.seek(r.at)
                    with open(os.path.join(work, f"{r.member}-{r.piece}"), "rb") as f:
                        out.write(f.read())
            yield one[["member"]]

    first = spark.createDataFrame([(k, starts[k] + len(packed(heads[k]))) for k in starts], "member int, first long")
    inside = F.sum("size").over(Window.partitionBy("member").orderBy("piece")) - F.col("size")  # a row for each piece
    placed = done.withColumn("inside", inside).join(F.broadcast(first), "member").select("member", "piece", (F.col("first") + F.col("inside")).alias("at"))
    placed.repartition("member", "piece").mapInPandas(put, "member int").agg(F.count("*")).collect()
    os.replace(staged, target)
    shown = spark.createDataFrame([(k, m[0].decode()) for k, m in enumerate(members)], "member int, name string")
    at_work = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{work}")
    at_work.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at_work, True)
    return found.join(F.broadcast(shown), "member").select("name", "n_rows", "n_bytes", "n_packed", "crc32", "sha256")


def require_archive(path: str, manifest: DataFrame) -> None:
    """Read the archive's members, each in its own task, and compare with the manifest; fails where one isn't as it says."""
    import zipfile

    target = unquote(urlparse(path).path) if path.startswith("file:") else path

    def check(frames):
        for one in frames:
            with zipfile.ZipFile(target) as z:
                for r in one.itertuples():
                    sha, n = hashlib.sha256(), 0
                    with z.open(r.name) as f:  # compares the sum at its end
                        while data := f.read(1 << 20):
                            sha.update(data)
                            n += len(data)
                    yield pd.DataFrame([(r.name, sha.hexdigest() == r.sha256 and n == r.n_bytes)], columns=["name", "same"])

    wrong = manifest.select("name", "n_bytes", "sha256").repartition("name").mapInPandas(check, "name string, same boolean").filter("NOT same").first()
    if wrong is not None:
        raise ContractError(f"{wrong.name} isn't what the manifest says")
