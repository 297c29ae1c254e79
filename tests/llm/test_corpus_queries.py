"""The opN_ queries on the smallest tables: columns, and their SQL where there is one."""

import duckdb
import pytest

from forgeframe.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["page_id", "host", "path", "rule", "verdict"],
    "op2": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op3": ["doc_id", "size", "source_size", "target", "taken"],
    "op4": ["doc_id", "held_out", "lang_pred", "score"],
    "op5": ["vec_id", "n_links", "component_id", "kept"],
    "op6": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op7": ["doc_id", "fingerprint", "component_id"],
    "op8": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op9": ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
    "op10": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_columns_and_rows(spark, name):
    df = queries.queries()[name](spark, SF)
    assert df.columns[: len(COLUMNS[name.split("_")[0]])] == COLUMNS[name.split("_")[0]]
    source = {"op1": "pages", "op5": "embeddings"}.get(name.split("_")[0], "documents")
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{SF}/{source}.parquet").count()
    if name not in queries.oracle_sql():
        return
    con = duckdb.connect()
    con.execute(f"CREATE VIEW {source} AS SELECT * FROM read_parquet('{SF}/{source}.parquet')")
    cur = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    key = lambda r: str(sorted(r.items()))
    want = sorted((dict(zip(names, r)) for r in cur.fetchall()), key=key)
    assert sorted((r.asDict() for r in rows), key=key) == want
