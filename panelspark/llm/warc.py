"""WARC archives compressed with Zstandard, one frame per record, and their reader.

An archive begins with a skippable frame that holds the dictionary; each record follows as one
frame of its own, so any run of whole frames can be read alone. Records with equal payloads are
written once in full, as a response; the others are revisits that refer to it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Magic of the skippable frame that holds the dictionary (a fixed value of the format).
DICT_MAGIC = 0x184D2A5D
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The dictionary is trained on so many pages, on so many characters of each; both bound what the driver holds.
SAMPLE_PAGES, SAMPLE_CHARS, DICT_BYTES = 200, 8192, 32_768
#: Bytes after which a writer starts another archive, and bytes of the runs of records that readers take.
ARCHIVE_BYTES, RUN_BYTES = 256 << 20, 4 << 20
LEVEL = 6
#: So many payloads, those with most copies, are told to every task (some 150 bytes each), which then leaves out their revisits in place.
COPIED = 100_000


class BadArchive(ValueError):
    """An archive or record that isn't as the format demands."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id, url: str | None, payload_digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{payload_digest}:{zlib.crc32((url or '').encode()):08x}>"


def record(page_id, url: str | None, payload: bytes | None, sha1: bytes, n_bytes: int, refers_to: int | None, refers_url: str | None, date: str) -> bytes:
    """The bytes of one record; without its payload it is a revisit."""
    revisit, own = payload is None, base64.b32encode(sha1).decode()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode() + (payload or b"")
    clean = "".join("%%%02X" % ord(c) if c in "\r\n" else c for c in url or "")
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, url, own)),
        ("WARC-Date", date),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", f"sha1:{own}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if revisit:
        head += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to, refers_url, own))]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """The fields of one record; raises BadArchive unless headers, lengths and digests hold."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not found or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise BadArchive("no WARC header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise BadArchive(f"header line without a colon: {line[:80]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise BadArchive(f"no {name}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise BadArchive(f"{fields['warc-record-id']}: Content-Length {size}, but {len(rest)} bytes follow")
    block = rest[:size]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise BadArchive(f"{fields['warc-record-id']}: the block's digest differs")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["warc-type"] == "response" and (len(payload) != length or fields["warc-payload-digest"] != f"sha1:{digest(payload)}"):
        raise BadArchive(f"{fields['warc-record-id']}: the payload's length or digest differs")
    page = lambda uri: int(p) if (p := uri.split(":")[2]) else None
    return {
        "page_id": page(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "payload_bytes": length,
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:"),
        "record_type": fields["warc-type"],
        "refers_to": page(fields["warc-refers-to"]) if "warc-refers-to" in fields else None,
        "payload": payload.decode() if fields["warc-type"] == "response" else None,
    }


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary if dictionary else b""


def read_dictionary(stream) -> tuple[zstandard.ZstdCompressionDict | None, int]:
    """The dictionary of the leading skippable frame, if there is one, and where the records begin."""
    start = stream.read_at(8, 0)
    if len(start) < 8 or struct.unpack("<I", start[:4])[0] != DICT_MAGIC:
        return None, 0
    size = struct.unpack("<I", start[4:])[0]
    raw = stream.read_at(size, 8)
    if len(raw) != size:
        raise BadArchive("the dictionary frame is cut short")
    if raw[:4] == b"\x28\xb5\x2f\xfd":  # it may be compressed itself
        raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
    return zstandard.ZstdCompressionDict(raw), 8 + size


def frames(data: bytes, dictionary: zstandard.ZstdCompressionDict | None) -> Iterator[bytes]:
    """Each whole frame of a run, decoded; frames that only carry user data are skipped."""
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while data:
        magic = struct.unpack("<I", data[:4])[0] if len(data) >= 8 else -1
        if magic in SKIPPABLE:
            data = data[8 + struct.unpack("<I", data[4:8])[0] :]
            continue
        one = decoder.decompressobj()
        try:
            out = one.decompress(data)
        except zstandard.ZstdError as e:
            raise BadArchive(str(e)) from e
        if not one.eof:
            raise BadArchive("a frame is cut short")
        yield out
        data = one.unused_data


def train(pages: DataFrame, page_id: str, url: str, html: str) -> bytes:
    """A dictionary from a bounded sample of pages, those with the least hashes; empty if these don't suffice for one.

    Tasks only hand on pages whose hashes are among the least four times as many or so, so the driver gets no more with more tasks.
    """
    beginnings = pages.select(F.substring(common.text_or_empty(html), 1, SAMPLE_CHARS).alias("x"), F.col(page_id).alias("i"), F.col(url).alias("u")).filter("x <> ''")
    share = min(1.0, 4 * SAMPLE_PAGES / max(1, pages.count()))
    low = beginnings.select("x", F.xxhash64("i", "u", "x").alias("h")).filter(F.col("h") <= int((share - 0.5) * (1 << 63) * 2) - (share == 1.0))
    rows = low.orderBy("h", "x").limit(SAMPLE_PAGES).collect()
    try:
        return zstandard.train_dictionary(DICT_BYTES, [r.x.encode() for r in rows]).as_bytes()
    except zstandard.ZstdError:
        return b""


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every page as a record into .warc.zst archives in ``folder``; returns the runs written (path, offset, length, records).

    Of pages with equal payloads of ``least_bytes`` or more, those with the least id are responses, the
    others revisits of it. A null page counts as empty; rows that repeat the least id are responses all;
    null ids rank last (records without a number). Other columns are not written.

    Which rows are responses is settled on ids and digests. Payloads stay where they are read as long as COPIED payloads at
    most have copies. With more, pages of the others are matched with the revisits by payload and id, for which they move;
    revisits of the COPIED payloads never move with a payload. Inner tables go when the archives are written.
    """
    with common.scratch(pages.sparkSession) as keep:
        runs, path = _write_archives(pages, folder, page_id, url, html, least_bytes, date)
        keep(path)
    return runs


def _write_archives(pages: DataFrame, folder: str, page_id: str, url: str, html: str, least_bytes: int, date: str) -> tuple[DataFrame, str]:
    spark = pages.sparkSession
    common.small_batches(spark)
    common.make_dir(folder)
    dictionary = spark.sparkContext.broadcast(train(pages, page_id, url, html))  # DICT_BYTES at most
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), common.text_or_empty(html).alias("html"))
    rows = rows.withColumns({"payload_key": F.sha2("html", 256), "sha1": F.unhex(F.sha1("html")), "n_bytes": F.octet_length("html").cast("long")})
    slim, _ = common.written(rows.drop("html"), "pages")
    short = F.col("n_bytes") < least_bytes
    firsts = slim.groupBy("payload_key").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first"), F.count("*").alias("n"))
    firsts, _ = common.written(firsts, "payloads")
    copied = firsts.filter("n > 1")
    beside = common.spread_join(slim.filter(~short), copied, "payload_key", "n", slim.count()).filter(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
    revisits = beside.select("page_id", "url", F.lit(None).cast("string").alias("html"), "sha1", "n_bytes", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))
    top, _ = common.written(copied.orderBy(F.desc("n"), "payload_key").limit(COPIED).select("payload_key", F.col("first.page_id").alias("first_id"), F.lit(True).alias("told")), "copied")
    responses = rows.join(F.broadcast(top), "payload_key", "left").filter(short | F.col("told").isNull() | F.col("page_id").eqNullSafe(F.col("first_id")))
    if copied.count() > COPIED:
        row_key = F.concat_ws(":", "payload_key", F.coalesce(F.col("page_id").cast("string"), F.lit("-")))
        others = beside.join(F.broadcast(top.select("payload_key")), "payload_key", "left_anti").select(row_key.alias("key"))
        unsettled = ~short & F.col("told").isNull()
        responses = responses.filter(~unsettled).unionByName(responses.filter(unsettled).withColumn("key", row_key).join(others, "key", "left_anti").drop("key"))
    responses = responses.select("page_id", "url", "html", "sha1", "n_bytes", F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("refers_url"))
    planned = responses.unionByName(revisits)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        coder = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **({"dict_data": zstandard.ZstdCompressionDict(dictionary.value)} if dictionary.value else {}))
        each = (r for b in batches for r in b.to_pylist())
        runs, number, row = [], 0, next(each, None)
        while row is not None:
            path = f"{folder}/part-{task.partitionId():05d}-{number:03d}.warc.zst"
            number += 1
            with common.put(path, uuid.uuid4().hex) as out:
                at = out.write(dictionary_frame(dictionary.value))
                begun, records = at, 0
                while row is not None and at < ARCHIVE_BYTES:
                    payload = None if row["html"] is None else row["html"].encode()
                    one = record(row["page_id"], row["url"], payload, row["sha1"], row["n_bytes"], row["refers_to"], row["refers_url"], date)
                    at += out.write(coder.compress(one))
                    records += 1
                    if at - begun >= RUN_BYTES:
                        runs.append((path, begun, at - begun, records))
                        begun, records = at, 0
                    row = next(each, None)
                if records:
                    runs.append((path, begun, at - begun, records))
        names = ["path", "offset", "length", "records"]
        yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in runs], pa.schema({"path": pa.string(), "offset": pa.int64(), "length": pa.int64(), "records": pa.int64()}))

    return common.written(planned.mapInArrow(write, "path string, offset long, length long, records long"), "warc-runs")


READ_KIND = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def read_archives(runs: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of runs (path, offset, length, records) of whole frames; payloads of revisits are null (their response has it)."""
    schema = pa.schema({"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.string()})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in (r for b in batches for r in b.to_pylist()):
            at, path = common.file_system(run["path"])
            with at.open_input_file(path) as stream:
                dictionary, begin = read_dictionary(stream)
                if run["offset"] < begin:
                    raise BadArchive(f"{run['path']}: records begin at {begin}")
                data, rows, n = stream.read_at(run["length"], run["offset"]), [], 0
            for raw in frames(data, dictionary):
                rows.append(parse(raw))
                n += 1
                if not payloads:
                    rows[-1]["payload"] = None
                if len(rows) == common.BATCH_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows = []
            if n != run["records"]:
                raise BadArchive(f"{run['path']}: {n} records, not {run['records']}")
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    dealt = common.one_by_one(runs.withColumn("run", F.concat_ws("@", "path", F.lpad(F.col("offset").cast("string"), 20, "0"))), "run").drop("run")
    return dealt.mapInArrow(read, READ_KIND)


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    back = read_archives(write_archives(pages, common.fresh_path(spark, "warc")), payloads=False)
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op8_warc": op8_warc}
