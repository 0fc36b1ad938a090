import duckdb
import pytest

import oracle
from tessera.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, name):
    assert oracle.rows(queries.QUERIES[name](spark, SF)) == oracle.sql_rows(queries.SQL[name], SF)


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))


def test_held_out_toxicity(spark):
    labels = dict(duckdb.sql("select doc_id, toxic from '/root/testdata/sf0.01/labels.parquet'").fetchall())
    got = [r for r in queries.QUERIES["op10_toxicity"](spark, "/root/testdata/sf0.01").collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in got) / len(got) > 0.9


def test_model_beats_its_base_on_held_out_text(spark):
    got = [r for r in queries.QUERIES["op8_lm_scores"](spark, "/root/testdata/sf0.01").collect() if r.held_out]
    assert sum(r.score for r in got) > sum(r.base_score for r in got)
