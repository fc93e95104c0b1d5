"""License scans: ordered signature rules over words.

A text is reduced to its words, lower-cased (A-Z) and parted by single spaces. Every rule has a
keyword, a word without which it can't match; the keywords among a text's words decide whether the
text is looked at any further, and which rules are. All rules of a keyword are first tried as one
expression, and only where that matches one by one. Each rule is a regular expression over words with a label, a confidence and
a tier of priority. A detection that lies inside another of the same or a higher tier is
suppressed. Three base phrases are reported wherever they stand and are never suppressed.

DataFrame functions only. Texts are read once; only texts that pass the prefilter go on, and what
is shuffled are detections.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, license_rules
from .license_rules import CONFIDENCE

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
BASE_KEYWORDS = {"cc by": "cc", "general public license": "general", "all rights reserved": "reserved"}


def rules() -> list[tuple[int, str, str, str, int, float]]:
    """(number, label, keyword, expression, tier, confidence), in order. No rule matches empty text."""
    return [(k, label, keyword, expr, tier, CONFIDENCE[tier]) for k, (label, tier, keyword, expr) in enumerate(license_rules.RULES)]


def _by_keyword() -> dict[str, list[tuple]]:
    """What is tried where a keyword occurs: (rule, label, expr, tier, confidence); base phrases have tier 0 and negative numbers."""
    out: dict[str, list[tuple]] = {}
    for k, (phrase, label) in enumerate(BASE.items()):
        out.setdefault(BASE_KEYWORDS[phrase], []).append((-1 - k, label, phrase, 0, 1.0))
    for number, label, keyword, expr, tier, conf in rules():
        out.setdefault(keyword, []).append((number, label, expr, tier, conf))
    return out


def between_words(expr: str) -> str:
    return f"(?<= )(?:{expr})(?= )"


def _table(spark: SparkSession) -> DataFrame:
    """The rules by keyword, as one literal; as large as the list of rules is."""
    rows = [{"keyword": k, "rule": n, "label": label, "expr": between_words(expr), "tier": tier, "confidence": conf} for k, tried in _by_keyword().items() for n, label, expr, tier, conf in tried]
    kind = "array<struct<keyword: string, rule: int, label: string, expr: string, tier: int, confidence: double>>"
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(rows)), kind)))


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else; texts of ASCII alone take the quicker way to the same."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def keywords_in(words: Column) -> Column:
    """The gate: keywords among the words of a text. Without its keyword no rule or base phrase can match."""
    return F.array_intersect(words, F.array(*map(F.lit, sorted(_by_keyword()))))


def hits(words: Column, keywords: Column) -> Column:
    """Of a text's keywords, those with a rule that matches: one expression for each keyword.

    The expressions are a literal array that one call goes through. A call for each of them would be compiled code for well over a
    hundred searches in one method, whose compilation takes memory beside the heap.
    """
    tried = [{"k": k, "e": between_words("|".join(f"(?:{expr})" for _, _, expr, _, _ in some))} for k, some in sorted(_by_keyword().items())]
    every = F.from_json(F.lit(json.dumps(tried)), "array<struct<k: string, e: string>>")
    return F.transform(F.filter(every, lambda t: F.array_contains(keywords, t["k"]) & F.rlike(words, t["e"])), lambda t: t["k"])


def places(words: Column, expr: Column) -> Column:
    """Array of struct(start, end): where ``expr`` matches between single spaces, counted in words."""
    marked = F.split(F.trim(F.regexp_replace(words, expr, F.lit("\x01$0\x02"))), " ")
    at = lambda test, plus: F.filter(F.transform(marked, lambda w, i: F.when(test(w), i + plus)), lambda i: i.isNotNull())
    starts = at(lambda w: w.startswith("\x01"), 0)
    ends = at(lambda w: w.endswith("\x02"), 1)
    return F.arrays_zip(starts.alias("start"), ends.alias("end"))


def scan(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score`` and ``detections``.

    ``detections``: array of struct(start, end, label, tier, confidence) of what wasn't suppressed, by start;
    ``score``: the largest confidence among them and the base phrases, 0 without any. A null text has no words.
    All columns of ``docs`` but ``text`` are kept, and repeated rows stay; columns of the new names are replaced.
    """
    rid, kept, gate = (common.free_name(docs, x) for x in ("__row", "__words", "__keywords"))
    t = common.text_or_empty(text)
    plain = F.trim(F.regexp_replace(t, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", " "))
    seen = docs.withColumn(kept, lower_ascii(plain)).withColumn(gate, F.split(kept, " "))
    seen = seen.withColumns({"n_words": F.when(F.col(kept) == "", 0).otherwise(F.size(gate)).cast("long"), gate: keywords_in(F.col(gate)), rid: F.monotonically_increasing_id()})
    seen = seen.withColumn(kept, F.when(F.size(gate) > 0, F.concat(F.lit(" "), F.col(kept), F.lit(" "))))
    seen, _ = common.written(seen if text == "n_words" else seen.drop(text), "license-texts")  # one pass over the texts; few keep their words
    some = seen.filter(F.col(kept).isNotNull()).select(rid, F.col(kept).alias("words"), hits(F.col(kept), F.col(gate)).alias("hit"))
    tried = some.select(rid, "words", F.explode("hit").alias("keyword")).join(F.broadcast(_table(docs.sparkSession)), "keyword")
    tried = tried.filter(F.expr("words rlike expr"))
    found = tried.select(rid, "rule", "label", "tier", "confidence", F.explode(places(F.col("words"), F.col("expr"))).alias("p")).select("*", "p.start", "p.end")
    before = Window.partitionBy(rid).orderBy("start", F.desc("end"), F.desc("tier"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.lit(False)
    for tier in sorted(CONFIDENCE):  # the furthest end so far among detections of this tier or above
        inside |= (F.col("tier") == tier) & F.coalesce(F.max(F.when(F.col("tier") >= tier, F.col("end"))).over(before) >= F.col("end"), F.lit(False))
    stay = found.withColumn("inside", inside).filter("NOT inside")
    base = F.col("tier") == 0
    summed = stay.groupBy(rid).agg(
        F.sum(base.cast("long")).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("confidence").alias("score"),
        F.array_sort(F.collect_list(F.when(~base, F.struct("start", "end", "label", "tier", "confidence")))).alias("detections"),
    )
    plain_docs = seen.drop(kept, gate, *[c for c in docs.columns if c in summed.columns and c != rid])
    every = plain_docs.join(summed, rid, "left").drop(rid)
    return every.fillna({"n_base": 0, "base_labels": "", "labels": "", "score": 0.0})


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"), "text")
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


QUERIES = {"op3_license_scan": op3_license_scan}
