"""Removal of repeated passages by longest-previous-factor arrays.

A byte goes if it lies in a string of LENGTH bytes that also starts in a document with a smaller id. Suffixes are
sorted to the depth of LENGTH bytes. For a suffix, the nearest one before and the nearest one behind it in this order that stand in
an earlier document give its longest previous factor; where that is LENGTH or longer, the window that starts there
repeats an earlier one. Only this is asked, so lengths of shared prefixes are kept as far as they reach LENGTH.

One suffix array of the whole corpus would move LENGTH bytes for each byte. Equal windows must meet in one
array, and others needn't, so windows are dealt out by a key that depends on nothing but the window: the least
hash of the strings of GRAM bytes in it. Neighbouring windows mostly share their key; a run of them travels as one
string, LENGTH - 1 bytes longer than the number of its windows.

1. Documents are written to the shared folder once. Tasks read its files, in blocks of documents, and texts are never shuffled.
2. Each block sends its distinct keys, five bytes each, to the keys' buckets. A key that no other text has is done with.
3. Runs of the other keys go to the buckets: each distinct string of a block once, with its least document. Windows of keys that very
   many texts share travel alone, dealt out by all their bytes, so that the contexts of a common phrase don't meet in one task.
4. A bucket's distinct strings, each with its least document, are sorted as suffixes in slices of bounded size; what is found goes
   back to the blocks as one bit a window.
5. Each block joins its windows to spans and cuts them out.

Everything is compared byte by byte in the end: hashes decide only where strings meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of a repeated string; of the strings whose hashes are keys.
LENGTH, GRAM = 50, 24
#: Documents of a file, and bytes of texts that a task works on together.
FILE_ROWS, BLOCK_BYTES = 16_384, 8 << 20
#: Bytes of a text that are hashed together: arrays of this size stay in the processor's cache.
PIECE_BYTES = 1 << 17
#: Bytes of written documents for which there is one bucket.
BUCKET_BYTES = 8 << 20
#: A key of more texts is hot: its windows are dealt out one by one.
HOT_TEXTS = 8192
#: Suffixes that are sorted together, unless more of them start with the same two bytes.
SLICE = 1 << 20
#: The order of null ids.
LAST = (1 << 63) - 1
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC4CEB9FE1A85EC53, 0xFF51AFD7ED558CCD))  # odd multipliers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(32)) * _B
    return x ^ x >> np.uint64(29)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """64-bit hashes of all strings of ``size`` bytes, by doubling."""
    part, width, done, have = (data.astype("u8") + np.uint64(1)) * _C, 1, None, 0
    while True:
        if size & width:
            if done is None:
                done = part
            else:
                n = min(len(done), len(part) - have)
                done = _mixed(done[:n] * _A + part[have : have + n])
            have += width
        if have == size:
            return done if have > 1 else _mixed(done)
        part, width = _mixed(part[:-width] * _A + part[width:]), 2 * width


def window_keys(data: np.ndarray, length: int, gram: int) -> np.ndarray:
    """The key of each window of ``length`` bytes: the least hash of the strings of ``gram`` bytes in it, spread evenly."""
    least, width, wanted = gram_hashes(data, gram), 1, length - gram + 1
    while 2 * width <= wanted:
        least, width = np.minimum(least[:-width], least[width:]), 2 * width
    if width < wanted:
        least = np.minimum(least[: width - wanted], least[wanted - width :])
    return _mixed(least)


def _pieces(texts: list[bytes], length: int) -> Iterator[tuple[int, int, list[bytes]]]:
    """(first text, offset in it, texts): short texts in groups of some PIECE_BYTES, pieces of longer ones alone; the next piece repeats length - 1 bytes."""
    first, size = 0, 0
    for row, text in enumerate(texts):
        if size and size + len(text) > PIECE_BYTES:
            yield first, 0, texts[first:row]
            size = 0
        if not size:
            first = row
        if len(text) > PIECE_BYTES:
            for at in range(0, len(text) - length + 1, PIECE_BYTES):
                yield row, at, [text[at : at + PIECE_BYTES + length - 1]]
        else:
            size += len(text) or 1
    if size:
        yield first, 0, texts[first:]


def key_runs(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows of one text that share a key: number of the text, first window, one behind the last, key. Runs end where pieces do."""
    found = [[np.zeros(0, "i4")], [np.zeros(0, "i4")], [np.zeros(0, "i4")], [np.zeros(0, "u8")]]
    for first, offset, some in _pieces(texts, length):
        data = np.frombuffer(b"".join(some), "u1")
        if len(data) < length:
            continue
        key = window_keys(data, length, gram)
        ends = np.cumsum(np.fromiter(map(len, some), "i8", len(some)))
        begins = np.concatenate(([0], ends[:-1]))
        stop = ends - length + 1  # windows from here on run into the next text
        edge = np.zeros(len(key) + 1, bool)
        edge[1:-1] = key[1:] != key[:-1]
        edge[begins[begins < len(key)]] = edge[stop[(stop > 0) & (stop < len(key))]] = edge[-1] = True
        at = np.flatnonzero(edge)
        number = np.searchsorted(ends, at[:-1], "right")
        inside = at[:-1] < stop[number]
        number, start, end = number[inside], at[:-1][inside], at[1:][inside]
        shift = offset - begins[number]
        for out, part in zip(found, (number + first, start + shift, end + shift, key[start]), strict=True):
            out.append(part.astype(out[0].dtype))
    return tuple(np.concatenate(parts) for parts in found)


def suffix_order(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``at`` of ``data`` ordered by the ``depth`` bytes there, ties as given; and whether each shares all of them with the one before it.

    Eight bytes are compared at a time, and only positions that are equal so far go on to the next eight. ``data`` must go on for
    ``depth`` bytes behind each position.
    """
    width = min(8, depth)
    word = np.zeros(len(at), "u8")
    for k in range(width):
        word = word << np.uint64(8) | data[at + k]
    order = np.argsort(word, kind="stable")
    same = np.concatenate(([False], word[order[1:]] == word[order[:-1]])) if len(at) else np.zeros(0, bool)
    while width < depth:
        open_ = same.copy()  # of a group of equals, also the first
        open_[:-1] |= same[1:]
        places = np.flatnonzero(open_)
        if not len(places):
            break
        step = min(8, depth - width)
        some, word = at[order[places]] + width, np.zeros(len(places), "u8")
        for k in range(step):
            word = word << np.uint64(8) | data[some + k]
        group = np.cumsum(~same[places])
        moved = np.lexsort((word, group))
        order[places] = order[places[moved]]
        word, first = word[moved], np.concatenate(([True], group[1:] != group[:-1]))
        same[places] = ~first & np.concatenate(([False], word[1:] == word[:-1]))
        width += step
    return order, same


def previous_factors(owner: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix, in suffix order, has the full depth.

    ``owner`` is each suffix's document, ``same`` whether it shares the full depth with the one before it. Runs of such
    neighbours are clusters; a previous or next smaller value of ``owner`` counts if it is in the suffix's cluster.
    """
    n = len(owner)
    cluster = np.cumsum(~same)
    hit = np.zeros(n, bool)
    for backwards in (False, True):
        value, group = (owner[::-1], cluster[::-1]) if backwards else (owner, cluster)
        before = np.arange(-1, n - 1)  # all between this place and the suffix are no smaller
        waiting = np.flatnonzero(np.concatenate(([False], group[1:] == group[:-1]))) if n else np.zeros(0, "i8")
        while len(waiting):
            near = before[waiting]
            on = near >= 0
            waiting, near = waiting[on], near[on]
            on = group[near] == group[waiting]
            waiting, near = waiting[on], near[on]
            on = value[near] >= value[waiting]
            done = waiting[~on]
            hit[n - 1 - done if backwards else done] = True
            waiting = waiting[on]
            before[waiting] = before[near[on]]
    return hit


def repeated_windows(strings: list[bytes], owners: np.ndarray, length: int = LENGTH) -> list[np.ndarray]:
    """For each string, of ``length`` bytes or more, and each window in it: whether a string of a smaller owner has the same window."""
    sizes = np.fromiter(map(len, strings), "i8", len(strings))
    data = np.frombuffer(b"".join(strings), "u1")
    windows = sizes - length + 1
    ends = np.cumsum(windows)
    at = np.arange(int(windows.sum())) + np.repeat(np.cumsum(sizes) - sizes - (ends - windows), windows)
    hit, number = np.zeros(len(at), bool), np.repeat(np.arange(len(strings), dtype="i4"), windows)
    head = np.zeros(len(at), "u2")
    for k in range(2):
        head = head << np.uint16(8) | data[at + k]
    bounds = np.cumsum(np.bincount(head, minlength=1 << 16)) if len(at) > SLICE else [len(at)]
    by_head, low = np.argsort(head, kind="stable") if len(at) > SLICE else np.arange(len(at)), 0
    for k, high in enumerate(bounds):  # slices of whole heads: equal windows are in one
        if high > low and (k + 1 == len(bounds) or bounds[k + 1] - low > SLICE):
            some = by_head[low:high]
            order, same = suffix_order(data, at[some], length)
            some = some[order]
            hit[some] = previous_factors(owners[number[some]], same)
            low = high
    return np.split(hit, ends[:-1])


def _blocks(uri: str) -> Iterator[tuple[list[int | None], list[bytes]]]:
    """Ids and texts of a written file, some BLOCK_BYTES at a time."""
    from pyarrow import parquet

    at, path = common.file_system(uri)
    ids, texts, size = [], [], 0
    with at.open_input_file(path) as file:
        for batch in parquet.ParquetFile(file).iter_batches(common.BATCH_ROWS, columns=["id", "text"]):
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.large_binary()).to_pylist(), strict=True):
                if texts and size + len(text) > BLOCK_BYTES:
                    yield ids, texts
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(text)
                size += len(text)
    if texts:
        yield ids, texts


class Block:
    """Texts of one block with the runs of their windows, and the block's distinct keys by bucket."""

    def __init__(self, ids: list[int | None], texts: list[bytes], length: int, gram: int, buckets: int):
        self.texts, self.length, self.n = texts, length, buckets
        self.owner = [LAST if i is None else i for i in ids]
        self.row, self.start, self.end, key = key_runs(texts, length, gram)
        order = np.argsort(key)
        fresh = np.concatenate(([True], key[order[1:]] != key[order[:-1]])) if len(key) else np.zeros(0, bool)
        self.keys, self.key, at = key[order[fresh]], np.empty(len(key), "i4"), np.flatnonzero(fresh)
        self.key[order] = np.cumsum(fresh) - 1
        del key
        self.texts_of = np.ones(len(at), "i8")  # texts that have each key
        several = np.repeat(np.diff(at, append=len(order)) > 1, np.diff(at, append=len(order)))
        pairs = np.unique(self.key[order[several]] * np.int64(len(texts)) + self.row[order[several]]) // len(texts)
        counted, n = np.unique(pairs, return_counts=True)
        self.texts_of[counted] = n
        bucket = ((self.keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype("i8")
        self.bounds = np.searchsorted(bucket, np.arange(buckets + 1))
        self.bucket = bucket

    def by_bucket(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        for b in np.flatnonzero(np.diff(self.bounds)).tolist():
            some = slice(self.bounds[b], self.bounds[b + 1])
            yield b, self.keys[some].astype("<u4"), np.minimum(self.texts_of[some], 255).astype("u1")

    def strings(self, states: dict[int, bytes]) -> tuple[list[tuple[int, int, int, int, int]], dict[int, dict[bytes, list[int]]]]:
        """Runs (row, start, end, bucket, number of the string) of shared keys; and by bucket the distinct strings, each with its number and least owner.

        ``states`` has, for each bucket, a byte for each key that ``by_bucket`` gave: 0 for one text, 1 for several, 2 for hot.
        """
        state = np.zeros(len(self.keys), "u1")
        for b, x in states.items():
            state[self.bounds[b] : self.bounds[b + 1]] = np.frombuffer(x, "u1")
        of_run = state[self.key]
        runs, found = [], {}
        shared = np.flatnonzero(of_run)
        more, n = self.length - 1, self.n
        columns = (self.row[shared], self.start[shared], self.end[shared], self.bucket[self.key[shared]], of_run[shared] == 2)
        for row, a, z, bucket, hot in zip(*(c.tolist() for c in columns), strict=True):
            text, owner = self.texts[row], self.owner[row]
            for i, j in ((i, i + 1) for i in range(a, z)) if hot else ((a, z),):
                string = text[i : j + more]
                b = (xxhash.xxh64_intdigest(string) >> 32) * n >> 32 if hot else bucket
                of_bucket = found.setdefault(b, {})
                known = of_bucket.get(string)
                if known is None:
                    known = of_bucket[string] = [len(of_bucket), owner]
                elif owner < known[1]:
                    known[1] = owner
                runs.append((row, i, j, b, known[0]))
        return runs, found


def _packed(strings: list[bytes]) -> dict[str, bytes]:
    return {"strings": zstandard.compress(b"".join(strings), 1), "sizes": zstandard.compress(np.fromiter(map(len, strings), "<u4", len(strings)).tobytes(), 1)}


def _unpacked(row: dict) -> Iterator[tuple[bytes, int]]:
    """The strings of a row and their owners."""
    sizes, data = np.frombuffer(zstandard.decompress(row["sizes"]), "<u4"), zstandard.decompress(row["strings"])
    ends = np.cumsum(sizes, dtype="i8")
    strings = (data[a:b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True))
    return zip(strings, np.frombuffer(zstandard.decompress(row["owners"]), "<i8").tolist(), strict=True)


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Rows of equal ``key``, which follow each other."""
    rows: list[dict] = []
    for row in (r for b in batches for r in b.to_pylist()):
        if rows and rows[0][key] != row[key]:
            yield rows[0][key], rows
            rows = []
        rows.append(row)
    if rows:
        yield rows[0][key], rows


def _dealt(rows: DataFrame, key: str, n: int) -> DataFrame:
    """One task for each value of ``key`` from 0 to n - 1, with its rows in a fixed order."""
    return rows.repartitionById(max(1, n), F.col(key)).sortWithinPartitions(key, *[c for c in ("bucket", "file", "block", "step") if c != key and c in rows.columns])


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of rows whose binary values make up some ``size`` bytes."""
    some, have = [], 0
    for row in rows:
        some.append(row)
        have += sum(len(v) for v in row.values() if isinstance(v, bytes)) + 64
        if have >= size:
            yield pa.RecordBatch.from_pylist(some, schema)
            some, have = [], 0
    if some:
        yield pa.RecordBatch.from_pylist(some, schema)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.large_binary()}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], _KINDS[c.split()[1]]) for c in ddl.split(", ")])


def _key_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each key of a bucket: whether one text has it, several have, or very many."""

    def rows() -> Iterator[dict]:
        for bucket, some in _groups(batches, "bucket"):
            keys = [np.frombuffer(r["keys"], "<u4") for r in some]
            _, number = np.unique(np.concatenate(keys), return_inverse=True)
            texts = np.bincount(number, np.concatenate([np.frombuffer(r["texts"], "u1") for r in some]))[number]
            state = ((texts > 1) + (texts > HOT_TEXTS).astype("u1")).astype("u1")
            for r, s in zip(some, np.split(state, np.cumsum([len(k) for k in keys])[:-1]), strict=True):
                if s.any():
                    yield {"file": r["file"], "block": r["block"], "step": 0, "bucket": bucket, "data": zstandard.compress(s.tobytes(), 1)}

    return _batches(rows(), _schema(MESSAGE))


def _found(length: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each string of a block, and its windows: whether the block's least document of it repeats an earlier one there."""

        def rows() -> Iterator[dict]:
            for bucket, some in _groups(batches, "bucket"):
                least: dict[bytes, int] = {}
                for r in some:
                    for s, owner in _unpacked(r):
                        if owner <= least.get(s, owner):
                            least[s] = owner
                strings = sorted(least, key=least.get)
                hits = dict(zip(strings, repeated_windows(strings, np.array([least[s] for s in strings], "i8"), length), strict=True))
                for r in some:
                    own = [hits[s] if owner == least[s] else np.ones(len(s) - length + 1, bool) for s, owner in _unpacked(r)]
                    yield {"file": r["file"], "block": r["block"], "step": 1, "bucket": bucket, "data": zstandard.compress(np.packbits(np.concatenate(own)).tobytes(), 1)}

        return _batches(rows(), _schema(MESSAGE))

    return search


MESSAGE = "file int, block int, step int, bucket int, data binary"
SENT = "bucket int, file int, block int"


def _joined(ranges: Iterator[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Spans that windows [a, b), in ascending order, cover; spans that touch are one."""
    out: list[tuple[int, int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b + length - 1)
        else:
            out.append((a, b + length - 1))
    return out


def _spans(block: Block, runs: list, strings: dict[int, dict[bytes, list[int]]], found: dict[int, bytes]) -> list[list[tuple[int, int]]]:
    """What goes from each text of a block."""
    own: dict[int, tuple] = {}  # by bucket: bits of all windows; of each string its first bit, how many are set, and its least owner
    for b, of_bucket in strings.items():
        sizes = np.fromiter(map(len, of_bucket), "i8", len(of_bucket)) - block.length + 1
        ends = np.cumsum(sizes)
        flat = np.unpackbits(np.frombuffer(found[b], "u1"), count=int(ends[-1]))
        own[b] = flat, (ends - sizes).tolist(), np.add.reduceat(flat, ends - sizes, dtype="i8").tolist(), [x[1] for x in of_bucket.values()]
    ranges: list[list[tuple[int, int]]] = [[] for _ in block.texts]
    owner = block.owner
    for row, a, z, b, number in runs:
        flat, first, n_set, least = own[b]
        if owner[row] > least[number] or n_set[number] == z - a:
            ranges[row].append((a, z))
        elif n_set[number]:
            edges = np.flatnonzero(np.diff(flat[first[number] : first[number] + z - a].view("i1"), prepend=0, append=0)).tolist()
            ranges[row] += [(a + x, a + y) for x, y in zip(edges[::2], edges[1::2], strict=True)]
    return [_joined(iter(r), block.length) for r in ranges]


def _messages(rows: list[dict]) -> dict[int, list[dict[int, bytes]]]:
    """By block: what each step sent, by bucket."""
    out: dict[int, list[dict[int, bytes]]] = {}
    for r in rows:
        if r["step"] >= 0:
            out.setdefault(r["block"], [{}, {}])[r["step"]][r["bucket"]] = zstandard.decompress(r["data"])
    return out


RESULT = "id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def repeated_passages(docs: DataFrame, doc_id: str, text: str, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row for each row of ``docs``: its id, ``n_bytes``, ``spans`` (of bytes, end exclusive) that go, and ``kept``, the bytes that stay, joined.

    A byte goes if it lies in a string of ``length`` bytes that also starts in a row with a smaller id, overlaps included; strings are
    judged on the input. Matches never cross texts. Repeated strings within one text, and in rows of equal ids, stay. A null
    text counts as empty and a text of under ``length`` bytes loses nothing. Null ids come last, and level with each other.
    Repeated rows all come back. Other columns are not read. ``kept`` needn't be valid UTF-8, as spans end at any byte.
    """
    if not 2 <= gram <= length:
        raise ValueError("gram must be between 2 and length")
    spark = docs.sparkSession
    common.small_batches(spark)
    with common.scratch(spark) as keep:
        rows = docs.select(F.col(doc_id).cast("long").alias("id"), common.text_or_empty(text).alias("text"))
        folder = common.scratch_path(spark, "passages")
        keep(folder)
        rows.write.option("maxRecordsPerFile", FILE_ROWS).parquet(folder)
        listed = [x for x in common.list_files(folder) if x[0].endswith(".parquet")]
        n = max(-(-sum(size for _, size in listed) // BUCKET_BYTES), 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
        files = common.path_rows(spark, [path for path, _ in listed])
        files, path = common.written(files, "passage-files")
        keep(path)

        def blocks(uri: str) -> Iterator[tuple[int, Block]]:
            for k, (ids, texts) in enumerate(_blocks(uri)):
                yield k, Block(ids, texts, length, gram, n)

        def send_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sent = ({"bucket": b, "file": f["file"], "block": k, "keys": keys.tobytes(), "texts": texts.tobytes()} for x in batches for f in x.to_pylist() for k, block in blocks(f["path"]) for b, keys, texts in block.by_bucket())
            return _batches(sent, _schema(f"{SENT}, keys binary, texts binary"))

        keys = common.one_by_one(files, "file").mapInArrow(send_keys, f"{SENT}, keys binary, texts binary")
        states, _ = common.written(_dealt(keys, "bucket", n).mapInArrow(_key_states, MESSAGE), "key-states")

        def send_strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def sent() -> Iterator[dict]:
                for number, some in _groups(batches, "file"):
                    said = _messages(some)
                    for k, block in blocks(some[0]["path"]) if said else ():
                        if k in said:
                            for b, strings in block.strings(said[k][0])[1].items():
                                owners = zstandard.compress(np.array([x[1] for x in strings.values()], "<i8").tobytes(), 1)
                                yield {"bucket": b, "file": number, "block": k, "owners": owners, **_packed(list(strings))}

            return _batches(sent(), _schema(f"{SENT}, owners binary, strings binary, sizes binary"))

        def to_files(messages: DataFrame) -> DataFrame:
            """Each file's messages, and a row for the file itself, in its own task."""
            known = files.select("file", F.lit(-1).alias("block"), F.lit(-1).alias("step"), F.lit(-1).alias("bucket"), F.lit(None).cast("binary").alias("data"), "path")
            return _dealt(messages.withColumn("path", F.lit(None).cast("string")).unionByName(known), "file", len(listed))

        strings = to_files(states).mapInArrow(send_strings, f"{SENT}, owners binary, strings binary, sizes binary")
        found, _ = common.written(_dealt(strings, "bucket", n).mapInArrow(_found(length), MESSAGE), "repeated")
        messages, path = common.written(states.unionByName(found), "messages")
        keep(path)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()}))
        for _, some in _groups(batches, "file"):
            said = _messages(some)
            for k, (ids, texts) in enumerate(_blocks(some[0]["path"])):
                spans: list[list[tuple[int, int]]] = [[] for _ in texts]
                if k in said:
                    block = Block(ids, texts, length, gram, n)
                    spans = _spans(block, *block.strings(said[k][0]), said[k][1])
                for at in range(0, len(texts), common.BATCH_ROWS):
                    some_of = slice(at, at + common.BATCH_ROWS)
                    kept = [b"".join(t[a:b] for a, b in zip([0, *(e for _, e in s)], [*(a for a, _ in s), len(t)], strict=True)) if s else t for t, s in zip(texts[some_of], spans[some_of], strict=True)]
                    columns = [pa.array(ids[some_of], pa.int64()), pa.array(map(len, texts[some_of]), pa.int64()), pa.array([[{"start": a, "end": b} for a, b in s] for s in spans[some_of]], kind), pa.array(kept, pa.large_binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "spans", "kept"])

    return to_files(messages).mapInArrow(cut, RESULT).withColumnRenamed("id", doc_id)


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: Bytes as pairs of hexadecimal digits; every window of 50 is compared with the least id that has it.
ORACLE_SQL = {
    "op11_suffix_dedup": r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
windows AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS w FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS p FROM docs)),
hits AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) AS least FROM windows) WHERE doc_id > least),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM hits),
numbered AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM numbered GROUP BY doc_id, k),
gaps AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM spans
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT docs.doc_id, string_agg(substr(h, CAST(2 * x + 1 AS BIGINT), CAST(2 * (coalesce(y, len(h) // 2) - x) AS BIGINT)), '' ORDER BY x, y NULLS LAST) AS h
  FROM gaps JOIN docs USING (doc_id) GROUP BY docs.doc_id),
sums AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id)
SELECT docs.doc_id, CAST(len(docs.h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.h, docs.h))) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
}
QUERIES = {"op11_suffix_dedup": op11_suffix_dedup}
