"""Each query of the engine against its SQL; those without SQL run and give rows."""

import pytest

from tests.oracle import duck_rows, spark_rows
from vocalake.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, name):
    names, rows = spark_rows(QUERIES[name](spark, sf_dir))
    assert rows
    if name in SQL:
        assert (names, rows) == duck_rows(sf_dir, SQL[name])


def test_entry_points_without_subpackage():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_dedup_runs_without_words(spark, tmp_path):
    """empty, blank and null texts as the SQL counts them."""
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES (0::BIGINT, ''), (1, chr(11) || ' '), (2, NULL), (3, 'a'), (4, 'a a b'), (5, chr(133) || ' b')) AS d(doc_id, text)")
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_kept, digest FROM ({SQL['text_dedup_runs']})").fetchall())
    assert sorted(map(tuple, QUERIES["text_dedup_runs"](spark, str(tmp_path)).select("doc_id", "n_kept", "digest").collect())) == want


@pytest.mark.parametrize("name", ["lm_logprob", "lm_logprob_standard", "lm_rescore_best"])
def test_logprob_goes_through_the_corpus_once(spark, sf_dir, name):
    """the conversations are cut into tokens at one place of the plan."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all(lower(line") == 1
