"""Registered queries against their SQL on the smallest tables: one of each kind."""

import glob
import os

import duckdb
import pytest

from lodestone.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
NAMES = ["squad_n_best", "squad_max_context", "examples_of_next_sentence", "tokens_whole_words_masked", "tokens_truncated_with_overflow", "file_glue_tasks", "file_sdf", "stream_conversations", "voxel_pooled", "embedding_poolings", "metric_auroc", "retrieval_target_rank_snapped", "smiles_graphs", "smiles_bonds", "cluster_butina", "cluster_split", "fragments_within_bounds", "rejected_rows", "retrieval_inner_product_cells", "tokens_variable_streams", "tokens_permuted", "stream_conversations_fitted", "file_documents", "file_lines_with_reference", "text_html_entities"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    return round(value, 7) + 0.0 if isinstance(value, float) else value


@pytest.mark.parametrize("name", NAMES)
def test_query_gives_the_rows_of_its_sql(spark, tables, name):
    got = QUERIES[name](spark, SF)
    found = tables.execute(ORACLE_SQL[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(got.columns)
    want = sorted((tuple(map(plain, r)) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr) == want


def test_every_query_has_a_name_of_its_own_and_sql_or_a_reason():
    assert set(ORACLE_SQL) <= set(QUERIES) and set(QUERIES) - set(ORACLE_SQL) == {"pca_projection", "decode_beam_search", "tokens_shuffled_streams"}
