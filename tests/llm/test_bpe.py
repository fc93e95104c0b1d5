import hashlib
import random

import public_tokenizers
from panelspark.llm import bpe
from pyspark.sql import functions as F
from tokenizers import Tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "b", "e", "t", " ", "  ", "\n", "é", "ß", "!", "'s", "'re", "1", "22", "the ", "<|endoftext|>", "<|", "漢", "́", "\x1c", "\x85", "՘", "aaaa", "\t", "==", "\0", "😀"]


def texts(n, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(BITS) for _ in range(rnd.randrange(0, 30))) for _ in range(n)]


def test_encoder_against_library():
    library, own = Tokenizer.from_file(PATH), bpe.PrefixBPE(open(PATH, encoding="utf-8").read())
    pieces = bpe.PieceMap(own, lambda w: own.encode_word(w.encode()), lambda parts: [i for p in parts for i in p], lambda s: [own.special[s]])
    for t in texts(8000) + [c * n for c in "ae=-0é " for n in (1, 2, 3, 7, 50, 1000)]:
        ids = library.encode(t, add_special_tokens=False).ids
        assert [i for p in pieces.values(t) for i in p] == ids, t
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([222, 10, 50256]) == library.decode([222, 10, 50256], skip_special_tokens=False)


def test_last_tokens_are_unique_and_counts_exact():
    library, own = Tokenizer.from_file(PATH), bpe.PrefixBPE(open(PATH, encoding="utf-8").read())
    for word in (" international", "unbelievablyish", "=" * 70, "zzzzqqqxy"):
        last, count = own.prefixes(word.encode())
        for n in range(1, len(word) + 1):
            ids = library.encode(word[:n], add_special_tokens=False).ids
            assert (last[n - 1], count[n - 1]) == (ids[-1], len(ids))


def test_memo_forgets_but_stays_right():
    memo = bpe.Memo(lambda x: x * 2, 3)
    assert [memo[k % 7] for k in range(50)] == [k % 7 * 2 for k in range(50)] and len(memo) <= 3


def prefix_counts(library, text):
    """Brute force: the library's tokens of each prefix, by its bytes."""
    ends = range(1, len(text) + 1) if len(text) <= 500 else [*range(1, 80), len(text) // 2, len(text)]
    return {len(text[:n].encode()): len(library.encode(text[:n], add_special_tokens=False).ids) for n in ends}


SPACED = ["\n", "\n\n", " ", "   ", "\t", "\r\n", "\u3000", "\xa0", "the", "é", "'re", "'ll", "'ve", "'", "s", "!!", "22", "<|endoftext|>", "<|end", "  \n\n\n\n", "theé's22!\n\n", "<|endoftext|> hi", "漢", "\x1c"]


def test_prefixes_and_cuts_equal_the_library():
    library, counts = Tokenizer.from_file(PATH), bpe._count_map(open(PATH, encoding="utf-8").read())
    rnd = random.Random(11)
    for t in [*SPACED, *texts(400, 5), *(" ".join(rnd.choice(["the", "a\nb", "éé", "!!", "x" * 9, "a  b", "c\n\nd"]) for _ in range(rnd.randrange(0, 12))) for _ in range(500)), *("".join(rnd.choice(SPACED) for _ in range(rnd.randrange(0, 12))) for _ in range(3000))]:
        want, got = prefix_counts(library, t), list(bpe._each_prefix(counts, t))
        assert len(got) == len(t.encode()) and {k: got[k - 1] for k in want} == want, t
        for budget in (0, 1, 2, 4, 9):
            want_cut = max((k for k, n in want.items() if n <= budget), default=0)
            assert bpe.cut_at(counts, t, budget) == bpe.cut_at(counts, t, budget, counts.quick(t)) == want_cut, (t, budget)


def test_counts_prefixes_and_cuts(spark):
    rows = [(k, t) for k, t in enumerate(texts(150, 2))] + [(900, None), (901, ""), (902, "word " * 5000), (902, "word " * 5000), (None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit("clash"))
    library = Tokenizer.from_file(PATH)
    by = dict(rows)
    got = bpe.count_tokens(docs, "text", PATH, (0, 3, 8), prefixes=True).collect()
    assert len(got) == len(rows)
    for r in got:
        t = by[r.doc_id] or ""
        assert (r.n_bytes, r.n_tokens) == (len(t.encode()), len(library.encode(t, add_special_tokens=False).ids))
        assert len(r.prefix_tokens) == r.n_bytes and (not t or r.prefix_tokens[-1] == r.n_tokens)
        each = prefix_counts(library, t)
        assert {k: r.prefix_tokens[k - 1] for k in each} == each
        assert len(t) > 500 or r.cut_bytes == [max((k for k, n in each.items() if n <= b), default=0) for b in (0, 3, 8)]


def test_encode_decode(spark):
    rows = [(k, t) for k, t in enumerate(texts(150, 3))] + [(900, None), (901, ""), (None, "x"), (1, texts(2, 3)[1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    library = Tokenizer.from_file(PATH)
    coded = bpe.encode_decode(docs, "text", PATH)
    for r in coded.select("*", *bpe.code_digests()).collect():
        ids = library.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (r.ids, r.decoded, r.n_tokens) == (ids, text, len(ids))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.count_tokens(docs, "text", PATH).collect() == [] and bpe.encode_decode(docs, "text", PATH).collect() == []
