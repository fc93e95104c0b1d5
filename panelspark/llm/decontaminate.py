"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the windows of the benchmark items: ten consecutive words, or a whole shorter
item. Patterns of one length form a search table. A shift table over blocks of two words tells,
for the block that ends at a position, how far the search may move on without missing a pattern;
where it says zero, a bucket keyed by that block lists the patterns that end with it, and these
are compared word by word.

The windows are cut into slices of bounded size, whatever the benchmark holds. Tasks write the slices
to the shared folder and workers load them from there; neither an item nor a slice passes through the driver. Every document is
searched for every slice, one slice at a time. Documents aren't shuffled for the search; with more than one slice they are
written once, and what later slices find joins them at the end.
"""

from __future__ import annotations

import functools
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import islice
from re import compile as pattern

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words of a window.
WINDOW = 10
#: Words of a block in the shift tables.
BLOCK = 2
#: Windows of items that a slice holds, or so; each is a pattern of WINDOW words at most.
TABLE_WORDS = 200_000
#: Windows that a task hands on at once.
CUT_ROWS = 10_000
_WORD = pattern(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words, as UTF-8: runs of digits, letters a-z and all beyond ASCII."""
    return _WORD.findall((text or "").encode().lower())


class WuManber:
    """Finds all occurrences of word patterns of one length in a list of words."""

    def __init__(self, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length = len(next(iter(patterns)))
        self.block = min(BLOCK, self.length)
        self.furthest = self.length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = defaultdict(list)
        for words, items in patterns.items():
            for end in range(self.block, self.length + 1):
                key = self._key(words, end)
                self.shift[key] = min(self.shift.get(key, self.furthest), self.length - end)
            self.buckets[self._key(words, self.length)].append((list(words), items))

    def _key(self, words, end: int):
        return words[end - 1] if self.block == 1 else (words[end - 2], words[end - 1])

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """(start, items) of each occurrence, from left to right."""
        length, shift, furthest, n = self.length, self.shift.get, self.furthest, len(words)
        one = self.block == 1
        end = length
        while end <= n:
            key = words[end - 1] if one else (words[end - 2], words[end - 1])
            move = shift(key, furthest)
            if move:
                end += move
                continue
            start = end - length
            for candidate, items in self.buckets[key]:
                if words[start:end] == candidate:
                    yield start, items
            end += 1


def windows_of(text: str | None) -> Iterator[tuple[bytes, ...]]:
    words = words_of(text)
    width = min(WINDOW, len(words))
    return (tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if words else iter(())


def search_tables(windows: Iterable[tuple[tuple[bytes, ...], str | None]]) -> list[WuManber]:
    """Search tables, one for each pattern length, of (window, item)."""
    by_length: dict[int, dict] = defaultdict(lambda: defaultdict(list))
    for window, item in windows:
        by_length[len(window)][window].append(item)
    return [WuManber(p) for _, p in sorted(by_length.items())]


def tables(items: Iterable[tuple[str | None, str]]) -> list[WuManber]:
    """Search tables of (item, text)."""
    return search_tables((w, item) for item, text in items for w in set(windows_of(text)))


def occurrences(searches: list[WuManber], words: list[bytes]) -> tuple[list[tuple[int, int]], list[int]]:
    """Merged intervals [start, end) of hit words, and the numbers of the items found, but None."""
    spans, found = [], set()
    for search in searches:
        for start, items in search.search(words):
            found.update(items)
            if spans and spans[-1][0] <= start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], start + search.length))
            else:
                spans.append((start, start + search.length))
    if len(searches) > 1:
        spans = merge(spans)
    return spans, sorted(found - {None})


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def write_slices(items: DataFrame, item_id: str, item_text: str) -> tuple[str, int]:
    """Write the distinct windows of all items (window, item), in slices of TABLE_WORDS or so; returns the folder and their number."""
    schema = pa.schema({"window": pa.string(), "item": pa.string()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            each = ({"window": b" ".join(w).decode(), "item": row["item"]} for w in windows_of(row["text"]))
            while part := list(islice(each, CUT_ROWS)):
                yield pa.RecordBatch.from_pylist(part, schema)

    wanted = items.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).filter(F.col("text").isNotNull())
    windows, path = common.written(wanted.mapInArrow(cut, "window string, item string").distinct(), "windows")
    n = max(1, -(-windows.count() // TABLE_WORDS))
    folder = common.scratch_path(items.sparkSession, "slices")
    windows.withColumn("slice", F.pmod(F.xxhash64("window", "item"), F.lit(n))).repartition(n, "slice").write.partitionBy("slice").parquet(folder)
    return folder, n


@functools.lru_cache(1)
def load_slice(uri: str) -> list[WuManber]:
    """The tables of one slice; a worker keeps the last it loaded."""
    from pyarrow import fs, parquet

    at, path = common.file_system(uri)
    if at.get_file_info(path).type == fs.FileType.NotFound:  # no window fell to it
        return []
    table, same = parquet.read_table(path, filesystem=at, partitioning=None), {}
    words = lambda window: tuple(same.setdefault(w, w) for w in window.encode().split(b" "))
    return search_tables((words(r["window"]), r["item"]) for b in table.to_batches() for r in b.to_pylist())


KIND = pa.struct({"n_words": pa.int64(), "spans": pa.list_(pa.struct({"start": pa.int64(), "end": pa.int64()})), "items": pa.list_(pa.string())})
SQL_KIND = "n_words long, spans array<struct<start: long, end: long>>, items array<string>"


def _searched(uri: str):
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        searches = load_slice(uri)
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                words = words_of(x)
                spans, found = occurrences(searches, words)
                rows.append({"n_words": len(words), "spans": [{"start": a, "end": b} for a, b in spans], "items": found})
            yield pa.array(rows, KIND)

    return F.arrow_udf(search, SQL_KIND)


def _merged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([[{"start": a, "end": b} for a, b in merge((s["start"], s["end"]) for s in spans)] for spans in batch.to_pylist()], KIND.field("spans").type)


def contamination(docs: DataFrame, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Adds ``n_words``, ``hit_spans`` (array of struct(start, end) over words), ``item_ids`` (strings, sorted), ``n_hit``, ``contaminated``.

    Null texts (documents or items) have no words, and an item without words has no window. Items with
    equal ids count as one; a null item id is left out of ``item_ids`` but its windows still hit. Rows of
    ``docs`` stay as they are, repeated ones too; columns of the new names are replaced.
    """
    common.small_batches(docs.sparkSession)
    folder, n = write_slices(items, item_id, item_text)
    got, rid = common.free_name(docs, "found"), common.free_name(docs, "__row")
    state = docs.withColumn(got, _searched(f"{folder}/slice=0")(F.col(text)))
    if n > 1:
        state, _ = common.written(state.withColumn(rid, F.monotonically_increasing_id()), "searched")
        hits = state.select(rid, F.col(f"`{got}`.spans"), F.col(f"`{got}`.items"))
        for k in range(1, n):
            later = state.select(rid, _searched(f"{folder}/slice={k}")(F.col(text)).alias("f")).select(rid, "f.spans", "f.items")
            hits = hits.unionByName(common.written(later.filter(F.size("spans") > 0), "hits")[0])
        all_of = hits.filter(F.size("spans") > 0).groupBy(rid).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        all_of = all_of.select(rid, F.arrow_udf(_merged, "array<struct<start: long, end: long>>")("spans").alias("spans"), "items")
        none = lambda c: F.coalesce(F.col(f"a.{c}"), F.array().cast(all_of.schema[c].dataType)).alias(c)
        joined = state.alias("s").join(all_of.alias("a"), rid, "left")
        state = joined.select(*(F.col(f"s.`{c}`") for c in docs.columns), F.struct(F.col(f"s.`{got}`.n_words").alias("n_words"), none("spans"), none("items")).alias(got))
    n_hit = F.aggregate(F.col(f"`{got}`.spans"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    state = state.withColumns({"n_words": F.col(f"`{got}`.n_words"), "hit_spans": F.col(f"`{got}`.spans"), "item_ids": F.col(f"`{got}`.items"), "n_hit": n_hit})
    return state.withColumn("contaminated", F.col("n_hit") > 0).drop(got)


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, "text", common.table(spark, sf_dir, "benchmark"), "item_id", "text")
    ids = F.array_join("item_ids", ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), "contaminated")


#: The windows as strings between single spaces; every start of every window is marked, then words inside are counted.
ORACLE_SQL = {
    "op6_decontamination": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS win, least(10, len(w)) AS width
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM windows),
starts AS (
  SELECT doc_id, width, i, array_to_string(w[i:i + width - 1], ' ') AS win
  FROM (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM words, widths)),
hits AS (SELECT DISTINCT s.doc_id, s.i, s.width, x.item_id FROM starts s JOIN windows x ON s.win = x.win AND s.width = x.width),
hit_words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + width)) AS p FROM hits) GROUP BY doc_id),
hit_items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT words.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
}
QUERIES = {"op6_decontamination": op6_decontamination}
