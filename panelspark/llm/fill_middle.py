"""Fill-in-the-middle transformation: texts are cut at two token boundaries and their parts reordered behind sentinels.

Tokens are what the tokenizers library's Split pre-tokenizer isolates with PATTERN; its offsets count code points. It is given
ALONE, which isolates the same tokens with half the matches, as it gives what stands between matches as tokens too. Their
number gives n, and offsets of the ranks that are drawn give the cuts; no vocabulary is needed. Draws come from a digest of
seed and document id, so they are the same in every run and for every order of rows.

A text's tokens are found piece by piece, so memory is bounded by the text and PIECE, not by the number of tokens. Parts are
cut, joined and put back together by DataFrame functions.
"""

from __future__ import annotations

import functools
import gc
import re
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PATTERN, ALONE = "[A-Za-z]+|[^A-Za-z]", "[^A-Za-z]"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Percentages of texts that stay plain, and of the others that put the suffix first.
PLAIN_FROM, SPM_BELOW, SEED = 90, 20, 1
#: Code points whose tokens are found together.
PIECE = 1 << 16
_CUT = re.compile("(?<![A-Za-z])|(?=[^A-Za-z])")


@functools.cache
def _splitter():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(ALONE), "isolated")


def pieces(text: str) -> Iterator[tuple[int, str]]:
    """(offset, piece) of a text, cut only where a token ends whatever stands around."""
    at = 0
    while at < len(text):
        end = len(text)
        if at + PIECE < end and (cut := _CUT.search(text, at + PIECE)):
            end = cut.start()
        yield at, text[at:end]
        at = end


def token_ends(text: str) -> np.ndarray:
    """Where each token of a text ends, in code points."""
    split = _splitter().pre_tokenize_str
    parts = [np.fromiter((end for _, (_, end) in split(piece)), "i8") + at for at, piece in pieces(text)]
    return np.concatenate(parts) if parts else np.zeros(0, "i8")


def draws(doc_id: str | Column, seed: int = SEED) -> list[Column]:
    """The first four groups of eight digits of the digest of seed and id, as numbers; a null id counts as an empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cuts_of(text: str, h1: int, h2: int) -> tuple[int, int, int]:
    """Number of tokens and, for two draws, where prefix and middle end; of a text in one piece only two tokens' offsets are read."""
    if len(text) <= PIECE:
        tokens = _splitter().pre_tokenize_str(text)
        n, end = len(tokens), lambda k: tokens[k - 1][1][1]
    else:
        ends = token_ends(text)
        n, end = len(ends), lambda k: int(ends[k - 1])
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, end(low) if low else 0, end(high) if high else 0


@contextmanager
def _uncollected() -> Iterator[None]:
    """Without Python's search for cycles: tokens are tuples by the thousand, which have none, and set it off again and again."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _cuts(texts: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
    """What ``cuts_of`` gives for texts and two draws."""
    for batch in texts:
        with _uncollected():
            rows = [cuts_of(*row) for row in zip(*(c.to_pylist() for c in batch), strict=True)]
        yield pa.StructArray.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(3)], ["n", "a", "b"])


def fill_in_middle(docs: DataFrame, doc_id: str, text: str, seed: int = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """Adds ``n`` (tokens), ``form`` (plain, psm or spm), ``prefix_chars``, ``middle_chars`` (code points; null if plain) and ``output``.

    A null text counts as empty; an empty text and one that holds a sentinel stay plain. Texts of equal ids are cut by equal
    draws, repeated rows alike; a null id draws as an empty string. Columns of the new names are replaced, others kept.
    """
    common.small_batches(docs.sparkSession)
    whole = common.text_or_empty(text)
    h1, h2, h3, h4 = draws(doc_id, seed)
    got, own = common.free_name(docs, "cuts"), common.free_name(docs, "whole_text")
    cut = docs.withColumn(own, whole).withColumn(got, F.arrow_udf(_cuts, "n long, a long, b long")(F.col(own), h1, h2))
    body, a, b = F.col(own), F.col(f"{got}.a"), F.col(f"{got}.b")
    marked = F.contains(body, F.lit(PREFIX)) | F.contains(body, F.lit(SUFFIX)) | F.contains(body, F.lit(MIDDLE))
    form = F.when((body == "") | marked | (h3 % 100 >= plain_from), "plain").when(h4 % 100 < spm_below, "spm").otherwise("psm")
    part = lambda start, n: F.substring(body, (start + 1).cast("int"), n.cast("int"))
    prefix, middle, suffix = part(F.lit(0), a), part(a, b - a), part(b, F.length(body) - b)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    spm = F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle)
    kind = common.free_name(docs, "form_of_text")
    cut = cut.withColumn(kind, form)
    made = {
        "n": F.col(f"{got}.n"),
        "form": F.col(kind),
        "prefix_chars": F.when(F.col(kind) != "plain", a),
        "middle_chars": F.when(F.col(kind) != "plain", b - a),
        "output": F.when(F.col(kind) == "plain", body).when(F.col(kind) == "psm", psm).otherwise(spm),
    }
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in made]
    return cut.select(*kept, *(v.alias(k) for k, v in made.items()))


def restored(output: str | Column, form: str | Column) -> Column:
    """The exact text from an output and its form."""
    out, kind = (F.col(c) if isinstance(c, str) else c for c in (output, form))
    behind = lambda s, mark: F.substring(s, F.instr(s, mark) + len(mark), F.length(s))
    before = lambda s, mark: F.substring_index(s, mark, 1)
    rest = F.substring(out, len(PREFIX) + 1, F.length(out))
    of = lambda mark: (before(rest, mark), before(behind(rest, mark), MIDDLE), behind(behind(rest, mark), MIDDLE))
    (prefix, suffix, middle), (suffix_first, prefix_then, middle_last) = of(SUFFIX), of(PREFIX)
    return F.when(kind == "plain", out).when(kind == "psm", F.concat(prefix, middle, suffix)).otherwise(F.concat(prefix_then, middle_last, suffix_first))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle(common.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored("output", "form"), 256).alias("restored_sha256"))


#: Tokens as a list; the text is put together again from the output's own parts.
ORACLE_SQL = {
    "op12_fill_middle": r"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d FROM documents),
drawn AS (
  SELECT doc_id, t, CAST('0x' || d[1:8] AS BIGINT) AS h1, CAST('0x' || d[9:16] AS BIGINT) AS h2, CAST('0x' || d[17:24] AS BIGINT) AS h3,
         CAST('0x' || d[25:32] AS BIGINT) AS h4, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS w FROM docs),
cut AS (
  SELECT *, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS x, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS y,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
              WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM drawn),
parts AS (
  SELECT *, array_to_string(w[1:x], '') AS p, array_to_string(w[x + 1:y], '') AS m, array_to_string(w[y + 1:], '') AS s FROM cut)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(p || m || s) AS restored_sha256
FROM parts
"""
}
QUERIES = {"op12_fill_middle": op12_fill_middle}
