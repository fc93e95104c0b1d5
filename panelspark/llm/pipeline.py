"""The corpus pipeline over ``documents``: five stages, each written as Parquet and read again.

Quality rules drop documents, of near-duplicates one stays, documents that share a window with a
benchmark item go, personal data in texts is replaced by its kind, and what is left becomes token
ids. Every stage but the last returns the columns that it was given; each treats nulls, empty
texts, repeated rows and empty tables as its operator says.

ORACLE_SQL is None: SQL has neither XXH64 fingerprints nor byte-pair encoding. tests/llm holds the
pipeline against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, pii, quality, simhash


def _held(docs: DataFrame) -> tuple[DataFrame, str]:
    """The documents' columns in one struct, out of reach of any operator's own columns, beside what operators read; and the struct's name."""
    name = common.free_name(docs, "__doc")
    return docs.select(F.struct("*").alias(name), "doc_id", "text", *[c for c in ("lang",) if c in docs.columns]), name


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go. Strata are languages, where there is such a column."""
    stratum = "lang" if "lang" in docs.columns else None
    held, doc = _held(docs)
    measured = quality.measure(held, "text")
    small, _ = common.written(measured.select("doc_id", *[stratum] * bool(stratum), "base_failed", *quality.RULES), "measured")  # without texts
    fitted = quality.fit(small, common.table(spark, sf_dir, "labels"), stratum=stratum)
    return quality.keep(quality.apply(measured, fitted, stratum)).select(f"{doc}.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked fingerprints, the document with the least id stays."""
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a window of a benchmark item occurs go."""
    held, doc = _held(docs)
    found = decontaminate.contamination(held, "text", common.table(spark, sf_dir, "benchmark"), "item_id", "text")
    return found.filter("NOT contaminated").select(f"{doc}.*")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of personal data are replaced by their kind; ``n_chars`` follows the text where there is such a column."""
    held, doc = _held(docs)
    found = pii.find(held, "text")
    weights = pii.fit(common.written(found.select("candidates"), "candidates")[0])  # without texts
    decided = pii.decide(found, weights=weights)
    clean = decided.select(doc, pii.redact(F.col("text"), F.col("spans")).alias("text"), (F.size("spans") > 0).alias("changed"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col("changed"), F.length("text")).otherwise(F.col(f"{doc}.n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.select(*(new.get(c, F.col(f"{doc}.`{c}`")).alias(c) for c in docs.columns))


def byte_pair_codes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, their number, and digests of them and of the text that they decode to."""
    kept = [c for c in ("doc_id", "lang", "source") if c in docs.columns]
    coded = bpe.encode_decode(docs.select(*kept, "text"), "text", bpe._path())
    return coded.select(*kept, "ids", *bpe.code_digests())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("byte_pair_codes", byte_pair_codes),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the table ``documents`` in ``sf_dir``."""
    docs, before = common.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with common.scratch(spark) as keep:
            docs, path = common.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep(path)
        if before:
            common.remove(spark, before)
        before = path
    return docs


QUERIES = {"pipeline": run}
