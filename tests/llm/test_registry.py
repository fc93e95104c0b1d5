"""Each operator has a query, and the queries' columns are those asked for."""

import re

from panelspark.llm import registry

COLUMNS = {
    1: ["doc_id", "n_bytes", "n_tokens", "over_limit"],
    2: ["doc_id", "start", "n_tokens", "ids_crc32"],
    3: ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    4: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    5: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    6: ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    7: ["doc_id", "fingerprint", "component_id"],
    8: ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    9: ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    10: ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    11: ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    12: ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    13: ["vec_id", "code", "error", "label_error", "codebooks_sha256"],
}


def test_names():
    names = registry.queries()
    assert sorted(int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))) == list(range(1, 14)) and "pipeline" in names
    assert set(registry.oracle_sql()) <= set(names)


def test_queries_run_whole_and_have_their_columns(spark):
    sf = "/root/testdata/sf0.001"
    rows = {"embeddings": spark.read.parquet(f"{sf}/embeddings.parquet").count(), "documents": spark.read.parquet(f"{sf}/documents.parquet").count(), "pages": spark.read.parquet(f"{sf}/pages.parquet").count(), "conversations": spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count() + 1}
    for name, query in registry.queries().items():
        if m := re.match(r"op(\d+)_", name):
            df = query(spark, sf)
            assert [c for c in COLUMNS[int(m[1])] if c not in df.columns] == [], name
            n = df.count()
            assert n == rows[{"8": "pages", "9": "conversations", "13": "embeddings"}.get(m[1], "documents")], name
