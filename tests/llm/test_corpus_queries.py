"""Every corpus query as registered, on the smallest tables."""

import duckdb
import pytest

from asmlens.llm import registry

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op2": "doc_id fingerprint component_id",
    "op3": "doc_id severity",
    "op4": "doc_id n_bytes n_removed n_spans kept_sha256",
    "op5": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op6": "vec_id n_links component_id kept",
    "op7": "doc_id size source_size target taken",
    "op8": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    "op9": "doc_id text_license",
    "op10": "doc_id shard",
    "op11": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256",
    "op12": "item_id rank doc_id score",
    "op13": "doc_id n_tokens ids_sha256 decoded_sha256",
}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    df = registry.QUERIES[name](spark, DATA)
    rows = df.collect()
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(df.columns)
    operator = name.split("_")[0]
    table, key = {"op6": ("embeddings", "vec_id"), "op8": ("conversations", "conv_id")}.get(operator, ("documents", "doc_id"))
    if operator not in ("op11", "op12"):  # one row a node; ten rows an item
        n = spark.read.parquet(f"{DATA}/{table}.parquet").select(key)
        assert len(rows) == (n.distinct().count() + 1 if table == "conversations" else n.count())
    if sql := registry.ORACLE_SQL.get(name):
        con = duckdb.connect()
        for view in ("documents", "conversations", "benchmark"):
            con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{DATA}/{view}.parquet'")
        found = con.execute(sql)
        names = [d[0] for d in found.description]
        order = sorted(names)
        assert order == sorted(df.columns)
        want = sorted(tuple(str(r[names.index(c)]) for c in order) for r in found.fetchall())
        assert sorted(tuple(str(r[c]) for c in order) for r in rows) == want
