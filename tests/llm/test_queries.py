"""The registered queries: names, columns, and the oracle where there is one."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from wavelake.llm import queries

SF = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_curve_neighbours": {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"},
    "op2_trie_token_counts": {"doc_id": "bigint", "n_pretokens": "bigint", "n_tokens": "bigint"},
    "op3_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op4_suffix_dedup": {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint",
                         "n_spans": "bigint", "kept_sha256": "string"},
    "op5_page_text": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op6_language_mixtures": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string",
                              "score": "double"},
    "op7_best_fit_packing": {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint",
                             "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op8_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint",
                        "target": "double", "taken": "bigint"},
    "op9_license_scan": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint",
                         "first_word": "bigint", "last_word": "bigint", "base_labels": "string",
                         "labels": "string", "score": "double"},
    "op10_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint",
                           "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint",
                           "base_failed": "boolean", "kept": "boolean"},
    "op11_vector_codes": {"vec_id": "bigint", "code": "string", "error": "bigint", "label_error": "bigint",
                          "codebooks_sha256": "string"},
    "op12_spelling_variants": {"word": "string", "form": "string", "root": "string", "n": "bigint",
                               "n_near": "bigint", "form_n": "bigint"},
    "op13_secret_scan": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint",
                         "base_sha256": "string", "spans": "string"},
}


def test_all_are_registered():
    assert set(queries.queries()) == set(COLUMNS)
    assert set(COLUMNS) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, name):
    out = queries.queries()[name](spark, SF)
    assert dict(out.dtypes) == COLUMNS[name]
    table = {"1": "embeddings", "5": "pages", "11": "embeddings"}.get(name[2:].split("_")[0], "documents")
    rows, given = out.count(), spark.read.parquet(f"{SF}/{table}.parquet").count()
    if name.startswith("op1_"):
        assert rows == 10 * spark.read.parquet(f"{SF}/{table}.parquet").filter("vec_id % 100 = 0").count()
    elif name.startswith("op7_"):
        assert rows >= given
    elif name.startswith("op12_"):
        assert rows == out.select("word").distinct().count() > 0
    else:
        assert rows == given


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{SF}/{table}.parquet')")
    want = con.sql(queries.oracle_sql()[name])
    got = queries.queries()[name](spark, SF).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)
