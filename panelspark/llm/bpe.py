"""Byte-pair encoding by dynamic programming over prefixes (token counts; encoding and decoding).

Every prefix of a byte string has exactly one encoding, so it has exactly one *last token*. The
table of last tokens is filled from left to right: an automaton over the vocabulary reports all
tokens that are a suffix of the prefix, and the one that may follow the last token of what
remains (no merge would have crossed the boundary between the two) is the one. Back-pointers then
give the ids, and a counter beside them the exact number of tokens of every prefix.

Texts are cut where the pre-tokenizer always cuts (before a run of white space), and what was
worked out for a piece is remembered in a memo of bounded size; this changes no result.
"""

from __future__ import annotations

import contextlib
import functools
import json
import unicodedata
from array import array
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: The split that byte-level vocabularies of this kind are made for (a fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a memo keeps in each of its two generations.
MEMO_ENTRIES = 250_000
NEVER = 1 << 60


class Uneven(Exception):
    """A piece begins or ends with white space, so the quick cut at single spaces isn't safe."""


class Memo(dict):
    """Computes what it lacks; forgets in two generations, so that hot keys stay."""

    def __init__(self, compute: Callable, entries: int = MEMO_ENTRIES):
        super().__init__()
        self.compute, self.entries, self.old = compute, entries, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_alphabet() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class PrefixBPE:
    """Encoder for one byte-level BPE vocabulary (the text of a tokenizers .json file)."""

    def __init__(self, source: str):
        spec = json.loads(source)
        model, alphabet = spec["model"], byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        vocab = {t: i for t, i in model["vocab"].items() if t not in self.special}
        self.token_bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.special.values()]))
        for token, i in vocab.items():
            self.token_bytes[i] = raw(token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        n = len(self.token_bytes)
        self.rank, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.merge_rank: dict[tuple[int, int], int] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            new = vocab[a + b]
            if self.rank[new] >= 0:
                raise ValueError(f"two merges make the token {a + b!r}")
            self.merge_rank[vocab[a], vocab[b]] = rank
            self.rank[new], self.left[new], self.right[new] = rank, vocab[a], vocab[b]
        own: list[bool] = [False] * n  # does the token's text encode to the token itself?
        for i in sorted(vocab.values(), key=self.rank.__getitem__):
            a, b, r = self.left[i], self.right[i], self.rank[i]
            own[i] = r < 0 or own[a] and own[b] and self.may_follow(a, b, r)
        self.automaton = ahocorasick.Automaton()
        for i in vocab.values():
            if own[i]:
                self.automaton.add_word(self.token_bytes[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.length = [len(t) for t in self.token_bytes]
        self.pairs: dict[int, bool] = {}
        self.split = regex.compile(SPLIT)
        self.pieces = regex.compile(r"\s*\S+|\s+")
        self.space = regex.compile(r"\s+")
        self.specials = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.library_split = None
        self.source = source

    def may_follow(self, a: int, b: int, before: int = NEVER) -> bool:
        """Does the text of ``a`` then ``b`` encode to those two (by merges ranked below ``before``)?

        Undoes, from the latest on, the merges that made the two tokens. What lies at the boundary at
        each time is a pair; if that pair has a merge that comes before the next merge on either side
        (equal pairs are merged from the left), it would have been merged across the boundary.
        """
        until_a = until_b = before
        while True:
            m = self.merge_rank.get((a, b))
            if m is not None and m < until_a and (m <= until_b if until_b != before else m < until_b):
                return False
            if self.rank[a] < 0 and self.rank[b] < 0:
                return True
            if self.rank[a] > self.rank[b]:
                until_a, a = self.rank[a], self.right[a]
            else:
                until_b, b = self.rank[b], self.left[b]

    def prefixes(self, word: bytes) -> tuple[list[int], list[int]]:
        """The last token and the number of tokens of each non-empty prefix of a pre-token."""
        last, count = [-1] * len(word), [0] * len(word)
        length, pairs = self.length, self.pairs
        for end, token in self.automaton.iter(word.decode("latin-1")):
            if last[end] >= 0:
                continue
            rest = end - length[token]
            if rest < 0:
                last[end], count[end] = token, 1
                continue
            key = last[rest] << 32 | token
            fits = pairs.get(key)
            if fits is None:
                if len(pairs) > 1_000_000:
                    pairs.clear()
                fits = pairs[key] = self.may_follow(last[rest], token)
            if fits:
                last[end], count[end] = token, count[rest] + 1
        return last, count

    def reach(self, piece: str) -> list[int]:
        """The tokens of each prefix of a piece, byte by byte, as a text that ends there has them.

        A text that ends sooner has other pre-tokens in two places. A run of white space is one pre-token where
        the text ends behind it, but leaves its last character to what follows where something does. A contraction of
        three characters is one only when whole. A prefix that ends inside a character counts that pre-token's bytes.
        """
        out: list[int] = []
        before, run, before_run = 0, None, 0
        for word in self.words(piece):
            raw = word.encode()
            own = self.prefixes(raw)[1]
            counts = [before + c for c in own]
            if word in ("'re", "'ve", "'ll"):
                counts[1] = before + own[0] + self.prefixes(raw[1:2])[1][0]
            if run is not None and self.space.fullmatch(word[0]):
                counts[len(word[0].encode()) - 1] = before_run + self.prefixes((run + word[0]).encode())[1][-1]
            out += counts
            run, before_run = (word, before) if self.space.fullmatch(word) else (None, 0)
            before += own[-1]
        return out

    def encode_word(self, word: bytes) -> list[int]:
        last, _ = self.prefixes(word)
        out, at = [], len(word) - 1
        while at >= 0:
            out.append(last[at])
            at -= self.length[last[at]]
        return out[::-1]

    def words(self, piece: str) -> list[str]:
        """Pre-tokens. Characters newer than one library's tables are split by the tokenizers library."""
        if not piece.isascii() and any(unicodedata.category(c) == "Cn" for c in piece):
            if self.library_split is None:
                from tokenizers import Tokenizer

                self.library_split = Tokenizer.from_str(self.source).pre_tokenizer
            return [piece[a:b] for _, (a, b) in self.library_split.pre_tokenize_str(piece)]
        return self.split.findall(piece)

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class PieceMap:
    """Maps a whole text to the values of its pieces, by memo."""

    def __init__(self, bpe: PrefixBPE, word: Callable[[str], object], total: Callable[[Iterator], object], special: Callable[[str], object]):
        """``word``: the value of a pre-token; ``total``: that of a piece from its pre-tokens' values."""

        def inner(piece: str):
            if not piece or piece[0].isspace() or piece[-1].isspace():
                raise Uneven
            return outer(" " + piece)

        def outer(piece: str):
            return total(map(self.of_word.__getitem__, bpe.words(piece)))

        self.bpe, self.special = bpe, special
        self.inner, self.outer, self.of_word = Memo(inner), Memo(outer, MEMO_ENTRIES // 5), Memo(word)

    def quick(self, text: str) -> list | None:
        """The values of the parts of a text between single spaces, each with the space before it; None where it can't be cut so."""
        if not text or any(s in text for s in self.bpe.special):
            return None
        parts = text.split(" ")
        try:
            if not parts[0] or parts[0][-1].isspace():
                raise Uneven
            return [self.outer[parts[0]], *map(self.inner.__getitem__, parts[1:])]
        except Uneven:
            return None

    def values(self, text: str) -> list:
        if (found := self.quick(text)) is not None:
            return found
        return [self.special(p) if special else self.outer[p] for p, special in self.pieces(text)]

    def value(self, piece: str):
        """The value of one piece, from the memo that ``values`` filled."""
        if piece[0] == " " and len(piece) > 1:
            with contextlib.suppress(Uneven):
                return self.inner[piece[1:]]
        return self.outer[piece]

    def pieces(self, text: str, at: int = 0) -> Iterator[tuple[str, bool]]:
        """The pieces of a text from a place between two of them on, and whether each is a special token."""
        for m in self.bpe.specials.finditer(text, at) if self.bpe.specials else ():
            yield from ((p[0], False) for p in self.bpe.pieces.finditer(text, at, m.start()))
            yield m[0], True
            at = m.end()
        yield from ((p[0], False) for p in self.bpe.pieces.finditer(text, at))


@functools.lru_cache(2)
def _encoder(source: str) -> PrefixBPE:
    return PrefixBPE(source)


@functools.lru_cache(2)
def _id_map(source: str) -> PieceMap:
    bpe = _encoder(source)
    packed = lambda ids: array("I", ids).tobytes()
    return PieceMap(bpe, lambda word: packed(bpe.encode_word(word.encode())), b"".join, lambda s: packed([bpe.special[s]]))


@functools.lru_cache(2)
def _count_map(source: str) -> PieceMap:
    bpe = _encoder(source)
    return PieceMap(bpe, lambda word: bpe.prefixes(word.encode())[1][-1], sum, lambda s: 1)


def vocabulary(spark: SparkSession, path: str):
    """Broadcast a vocabulary file; its size is that of the vocabulary, whatever the corpus holds."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def _inside(counts: PieceMap, piece: str, special: bool, before: int, last: tuple[str, int] | None) -> list[int]:
    """The tokens of the prefixes that end in a piece, byte by byte; ``before``: those of all pieces before it.

    The string of a special token is plain text until it is whole, and joins ``last``, the piece right before it (with
    the tokens before that).
    """
    if not special:
        return [before + c for c in counts.bpe.reach(piece)]
    text, base = last or ("", before)
    out: list[int] = []
    for k, c in enumerate(piece[:-1], 1):
        out += [base + sum(counts.values(text + piece[:k]))] * len(c.encode())
    return out + [before + 1] * len(piece[-1].encode())


def _each_prefix(counts: PieceMap, text: str) -> Iterator[int]:
    before, last = 0, None
    for piece, special in counts.pieces(text):
        yield from _inside(counts, piece, special, before, last)
        last = None if special else (piece, before)
        before += 1 if special else counts.value(piece)


def cut_at(counts: PieceMap, text: str, budget: int, quick: list | None = None) -> int:
    """UTF-8 bytes of the longest prefix of ``text``, in whole characters, that takes ``budget`` tokens at most.

    A longer prefix may take fewer tokens than a shorter one, but never fewer than the pieces before the last two. Parts that fit
    as a whole are passed over by the counts in ``quick``, what PieceMap.quick says of the text.
    """
    at = used = start = 0
    if quick is not None:
        for k, n in enumerate(quick):  # noqa: B007
            if used + n > budget:
                break
            used += n
        else:
            return len(text.encode())
        start = sum(map(len, text.split(" ", k)[:k])) + max(0, k - 1)
        at = len(text[:start].encode())
    best, earlier, last = at, used, None
    for piece, special in counts.pieces(text, start):
        if earlier > budget:
            break
        raw, n = piece.encode(), 1 if special else counts.value(piece)
        if used + n <= budget:
            best = at + len(raw)
        else:
            fits = [k for k, c in enumerate(_inside(counts, piece, special, used, last), 1) if c <= budget and (k == len(raw) or raw[k] & 0xC0 != 0x80)]
            best = max([best, *(at + k for k in fits)])
        last = None if special else (piece, used)
        earlier, used, at = used, used + n, at + len(raw)
    return best


def count_tokens(docs: DataFrame, text: str, path: str, budgets: tuple[int, ...] = (512,), prefixes: bool = False) -> DataFrame:
    """Exact token counts of whole texts and of their prefixes.

    Adds ``n_bytes``, ``n_tokens``, ``cut_bytes`` (for each budget, the UTF-8 bytes of the longest prefix
    of whole characters whose tokens stay within it) and, with ``prefixes``, ``prefix_tokens``: the tokens of
    each prefix, byte by byte, which answers any further budget without encoding again. Where a character ends,
    this is what the library counts for a text that ends there. A null text counts as empty: 0, 0, zeros, no prefixes.
    Columns of the same names are replaced; repeated rows stay; a text of any length is taken whole.
    """
    source = vocabulary(docs.sparkSession, path)
    common.small_batches(docs.sparkSession)
    kind = pa.struct({"n_bytes": pa.int64(), "n_tokens": pa.int64(), "cut_bytes": pa.list_(pa.int64()), "prefix_tokens": pa.list_(pa.int32())})

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = _count_map(source.value)
        for batch in batches:
            rows = []
            for x in batch.to_pylist():
                quick = counts.quick(x := x or "")
                n = sum(counts.values(x) if quick is None else quick)
                size = len(x.encode())
                cuts = [size if n <= b else cut_at(counts, x, b, quick) for b in budgets]
                rows.append({"n_bytes": size, "n_tokens": n, "cut_bytes": cuts, "prefix_tokens": list(_each_prefix(counts, x)) if prefixes else None})
            yield pa.array(rows, kind)

    udf = F.arrow_udf(count, "n_bytes long, n_tokens long, cut_bytes array<long>, prefix_tokens array<int>")
    got = common.free_name(docs, "counted")
    new = ["n_bytes", "n_tokens", "cut_bytes", *["prefix_tokens"] * prefixes]
    return docs.withColumn(got, udf(F.col(text))).withColumns({c: F.col(f"`{got}`.{c}") for c in new}).drop(got)


def encode_decode(docs: DataFrame, text: str, path: str) -> DataFrame:
    """Token ids of whole texts, and the text that these ids decode to.

    Adds ``ids`` (array of int) and ``decoded``. Strings of special tokens inside a text become those
    tokens, as by default in the library. A null text counts as empty: no ids, empty text. Columns of
    the same names are replaced; repeated rows stay; a text of any length is taken whole.
    """
    source = vocabulary(docs.sparkSession, path)
    common.small_batches(docs.sparkSession)

    def both(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        ids_of, bpe = _id_map(source.value), _encoder(source.value)
        for batch in batches:
            ids = [b"".join(ids_of.values(x)) if x else b"" for x in batch.to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype="i4")
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())
            texts = pa.array([bpe.decode(np.frombuffer(x, "<u4").tolist()) for x in ids], pa.string())
            yield pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), flat), texts], ["ids", "decoded"])

    udf = F.arrow_udf(both, "ids array<int>, decoded string")
    got = common.free_name(docs, "coded")
    return docs.withColumn(got, udf(F.col(text))).withColumns({c: F.col(f"`{got}`.{c}") for c in ("ids", "decoded")}).drop(got)


def _path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = count_tokens(common.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _path())
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), F.col("cut_bytes")[0].alias("cut_512_bytes"))


def code_digests() -> list[Column]:
    """``n_tokens`` and the digests of ``ids`` (decimal, comma-joined) and ``decoded``."""
    return [
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    ]


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_decode(common.table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _path())
    return coded.select("doc_id", *code_digests())


QUERIES = {"op1_token_counts": op1_token_counts, "op5_bpe_codec": op5_bpe_codec}
