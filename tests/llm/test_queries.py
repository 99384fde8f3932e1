"""The registered queries: their columns, and their SQL where there is one."""

import duckdb
import pytest

from leafmill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2_token_counts": "source lang tokenizer n_docs n_tokens",
    "op3_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op4_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op5_main_text": "page_id url text n_chars",
    "op6_neighbours": "query_id rank vec_id score",
    "op7_shards": "doc_id size text_crc32 law shard slot grown_shard",
    "op8_line_dedup": "doc_id n_lines n_dropped kept_sha256",
    "op9_secrets": "doc_id n_assign n_access n_hex base_sha256 spans",
    "op10_near_duplicates": "doc_id class_id",
    "op11_spelling": "word form root n n_near form_n",
    "op12_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified",
    "op13_language": "doc_id held_out lang_pred score",
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_whole_tables(spark, name):
    df = QUERIES[name](spark, SF)
    want = COLUMNS[name].split()
    assert df.columns[: len(want)] == want
    got = df.collect()
    table = {"op5_main_text": "pages", "op6_neighbours": None, "op2_token_counts": None, "op11_spelling": None}.get(name, "documents")
    if table:
        rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
        assert len({r[0] for r in got}) == rows and (name == "op3_packing" or len(got) == rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_like_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    want = con.sql(ORACLES[name])
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(tuple(r) for r in got) == sorted(want.fetchall())
