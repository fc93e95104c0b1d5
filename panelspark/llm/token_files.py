"""Token ids in Arrow stream files of equal-length sequences.

A shard is one Arrow stream file. Its batches hold two fixed-size-list columns, ``ids`` and
``mask``: consecutive runs of SEQUENCE ids of all the shard's documents, one after the other, with
a mask that is true where an id stands (the last sequence is filled up). All batches but the last
have BATCH sequences, so sequence k lies in batch k // BATCH, and a memory-mapped shard is read at
random without copying. A second stream file beside it says where each document begins.

Shards hold documents in ascending order of ids, and a table in the folder has each shard's first
position in the whole corpus.
"""

from __future__ import annotations

import functools
import gc
import os
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, common

SEQUENCE, BATCH = 2048, 64
#: Pieces of text that a worker remembers, in each of two generations.
MEMO_ENTRIES = 800_000
#: ASCII punctuation: neither letters, digits nor white space to the library's split.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


class LibraryEncoder:
    """Ids by the tokenizers library, which sees each unit of text once while a worker remembers it.

    The library always cuts before a run of white space, and between a letter or digit and the punctuation
    behind it. So a text is cut at single spaces; a piece that isn't remembered is cut on at line ends and
    before trailing punctuation, and only units that aren't remembered either go to the library.
    """

    def __init__(self, source: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(source)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.size = self.library.get_vocab_size()
        self.kind = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        self.pieces: dict[str, bytes] = {}  # without the space before them
        self.units: dict[str, bytes] = {}
        self.old_pieces: dict[str, bytes] = {}
        self.old_units: dict[str, bytes] = {}

    def _ask(self, texts: list[str]) -> list[bytes]:
        return [array(self.kind.char, e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def cut(piece: str) -> list[str] | None:
        """The units of a piece with what precedes it; None where white space makes a cut unsafe."""
        units = []
        for line in piece.replace("\n", "\0\n").split("\0") if "\n" in piece else (piece,):
            if line[-1:].isspace() or line[1:2].isspace():
                return None
            stem = line.rstrip(PUNCTUATION)
            units += [stem, line[len(stem) :]] if len(stem) < len(line) and stem[-1:].isalnum() else [line]
        return units

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        if len(self.pieces) > MEMO_ENTRIES:
            self.old_pieces, self.pieces = self.pieces, {}
        if len(self.units) > MEMO_ENTRIES // 4:
            self.old_units, self.units = self.units, {}
        get, found, words, mixed, ask = self.pieces.get, [], [], [], {}
        for text in texts:
            if "\0" in text or any(s in text for s in self.special):
                found.append(None)
                continue
            parts = text.split(" ")
            values = list(map(get, parts))
            values[0] = None if text else b""
            found.append(values if None not in values or self._missing(parts, values, words, mixed, ask) else None)
        got = dict(zip(ask, self._ask(list(ask)), strict=True))
        pieces = self.pieces
        for values, at, part, unit in words:
            values[at] = pieces[part] = got[unit]
        for values, at, part, units in mixed:
            values[at] = x = b"".join([u if type(u) is bytes else got[u] for u in units])
            if at and "\n" not in part:
                pieces[part] = x
            for u in units:
                if type(u) is str:
                    self._learn(u, got[u])
        left = [k for k, v in enumerate(found) if v is None]
        whole = dict(zip(left, self._ask([texts[k] for k in left]), strict=True))
        return [whole[k] if v is None else b"".join(v) for k, v in enumerate(found)]

    def _learn(self, unit: str, ids: bytes) -> None:
        """A word with a space before it is a piece like any other; the rest are units."""
        if unit[0] == " " and unit[1:].isalnum():
            self.pieces[unit[1:]] = ids
        else:
            self.units[unit] = ids

    def _known(self, unit: str) -> bytes | str:
        """The ids of a unit, or the unit itself if it isn't remembered."""
        if unit[0] == " " and unit[1:].isalnum():
            return self.pieces.get(unit[1:]) or self.old_pieces.get(unit[1:]) or unit
        return self.units.get(unit) or self.old_units.get(unit) or unit

    def _missing(self, parts: list[str], values: list, words: list, mixed: list, ask: dict) -> bool:
        """Takes what an older generation has, and notes what the library must be asked; False where white space makes cuts unsafe."""
        old, pieces = self.old_pieces.get, self.pieces
        at = values.index(None)
        while True:
            part = parts[at]
            x = old(part) if at else None
            if x is not None:
                values[at] = pieces[part] = x
            elif at and part.isalnum():
                unit = " " + part
                ask[unit] = None
                words.append((values, at, part, unit))
            else:
                if at and not part or not at and part[:1].isspace():
                    return False
                units = self.cut(" " + part if at else part)
                if units is None:
                    return False
                units = [self._known(u) for u in units if u]
                for u in units:
                    if type(u) is str:
                        ask[u] = None
                mixed.append((values, at, part, units))
            try:
                at = values.index(None, at + 1)
            except ValueError:
                return True


@functools.lru_cache(1)
def _library(source: str) -> LibraryEncoder:
    return LibraryEncoder(source)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.FixedSizeListArray:
    return pa.FixedSizeListArray.from_arrays(pa.array(values, kind), SEQUENCE)


class ShardWriter:
    """Writes one shard from packed ids, as they come."""

    def __init__(self, stream, kind: np.dtype):
        self.kind, self.width = kind, BATCH * SEQUENCE
        self.arrow = pa.from_numpy_dtype(kind)
        self.schema = pa.schema({"ids": pa.list_(self.arrow, SEQUENCE), "mask": pa.list_(pa.bool_(), SEQUENCE)})
        self.out = pa.ipc.new_stream(stream, self.schema)
        self.waiting: list[np.ndarray] = []
        self.have = self.total = 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.have += len(ids)
        self.total += len(ids)
        if self.have >= self.width:
            flat = np.concatenate(self.waiting)
            for at in range(0, len(flat) - self.width + 1, self.width):
                self._batch(flat[at : at + self.width], self.width)
            self.waiting = [flat[len(flat) - len(flat) % self.width :]]
            self.have = len(self.waiting[0])

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        self.out.write_batch(pa.RecordBatch.from_arrays([_lists(flat, self.arrow), _lists(mask, pa.bool_())], schema=self.schema))

    def close(self) -> None:
        if self.have:
            flat = np.concatenate(self.waiting)
            filled = np.zeros(-(-len(flat) // SEQUENCE) * SEQUENCE, self.kind)
            filled[: len(flat)] = flat
            self._batch(filled, len(flat))
        self.out.close()


class ShardReader:
    """Random access to a shard; without copying where the buffer is memory-mapped."""

    def __init__(self, buffer):
        with pa.ipc.open_stream(buffer) as stream:
            self.batches = [b for b in stream]

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def sequence(self, k: int) -> tuple[np.ndarray, pa.Array]:
        """Ids (a view) and mask of sequence k."""
        batch, row = self.batches[k // BATCH], k % BATCH
        ids = batch.column("ids")
        return self._flat(ids)[row * SEQUENCE : (row + 1) * SEQUENCE], batch.column("mask")[row].values

    @staticmethod
    def _flat(lists: pa.FixedSizeListArray) -> np.ndarray:
        return lists.flatten().to_numpy(zero_copy_only=True)

    def tokens(self, start: int, n: int) -> np.ndarray:
        """The n ids from position ``start`` of the shard on."""
        width, parts = BATCH * SEQUENCE, []
        while n:
            flat = self._flat(self.batches[start // width].column("ids"))
            part = flat[start % width : start % width + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, "<u2")


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 2) -> DataFrame:
    """Encode whole texts and write shards in ascending order of ``doc_id``; returns the shards (shard, path, tokens, documents, start).

    Each text's ids are followed by ``end_id``; a null text counts as empty and has just that. Null ids come
    first; rows with equal ids are ordered by a hash of the text, and repeated rows are all written. Other
    columns are not written. Texts move once, to bring ids into order.
    """
    spark = docs.sparkSession
    common.small_batches(spark)
    common.make_dir(folder)
    source = bpe.vocabulary(spark, tokenizer)
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(text).alias("tie"), common.text_or_empty(text).alias("text"))
    ordered = rows.repartitionByRange("id", "tie").sortWithinPartitions("id", "tie")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        gc.disable()  # the encoder makes many short-lived containers, and no cycles
        coder, part = _library(source.value), TaskContext.get().partitionId()
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        path, attempt = f"{folder}/shard-{part:06d}", uuid.uuid4().hex
        index = pa.schema({"doc_id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64()})
        end, documents = np.array([end_id], coder.kind), 0
        with common.put(f"{path}.arrow", attempt) as stream, common.put(f"{path}.docs.arrow", attempt) as beside:
            shard, docs_out = ShardWriter(stream, coder.kind), pa.ipc.new_stream(beside, index)
            batch = first
            while batch is not None:
                packed = [np.frombuffer(x, coder.kind) for x in coder.encode(batch.column("text").to_pylist())]
                sizes = np.array([len(x) + 1 for x in packed], "i8")
                starts = shard.total + np.cumsum(sizes) - sizes
                docs_out.write_batch(pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(starts), pa.array(sizes)], schema=index))
                for x in packed:
                    shard.add(x)
                    shard.add(end)
                documents += len(packed)
                batch = next(batches, None)
            shard.close()
            docs_out.close()
        yield pa.RecordBatch.from_pylist([{"shard": part, "path": path, "tokens": shard.total, "documents": documents}])

    shards, _ = common.written(ordered.select("id", "text").mapInArrow(write, "shard long, path string, tokens long, documents long"), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    shards = shards.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    shards.write.parquet(f"{folder}/shards")
    return spark.read.schema(shards.schema).parquet(f"{folder}/shards")


def read_tokens(shards: DataFrame) -> DataFrame:
    """Documents of the shards: doc_id, start (position in the whole corpus), n_tokens and ids (unsigned 32-bit little-endian, packed)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in (r for b in batches for r in b.to_pylist()):
            at, path = common.file_system(one["path"])
            opened = (lambda p: pa.memory_map(p)) if at.type_name == "local" else at.open_input_file
            with opened(f"{path}.arrow") as file, opened(f"{path}.docs.arrow") as beside:
                shard = ShardReader(file)
                for docs in pa.ipc.open_stream(beside):
                    spans = zip(docs.column("start").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True)
                    ids = [shard.tokens(a, n).astype("<u4").tobytes() for a, n in spans]
                    start = pa.compute.add(docs.column("start"), one["start"])
                    yield pa.RecordBatch.from_arrays([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(ids, pa.binary())], ["doc_id", "start", "n_tokens", "ids"])

    return common.one_by_one(shards, "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    shards = write_tokens(docs, common.fresh_path(spark, "tokens"), bpe._path())
    return read_tokens(shards).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op2_token_files": op2_token_files}
