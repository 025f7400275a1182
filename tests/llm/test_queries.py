"""The registered queries against their SQL, and the pipeline against the operators in plain Python."""

import pytest

import corpus_pipeline
from tests.oracle import duck_rows, spark_rows
from vocalake.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf_dir, name):
    assert spark_rows(queries.queries()[name](spark, sf_dir)) == duck_rows(sf_dir, queries.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_runs(spark, sf_dir, name):
    assert queries.queries()[name](spark, sf_dir).count()


def test_pipeline(spark, sf_dir):
    from vocalake.llm import pieces

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    seen = []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        seen.append(docs.count())
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns and docs.filter("n_chars <> length(text)").count() == 0
            texts = [r.text for r in docs.collect()]
    assert seen[0] == seen[1] > seen[2] and seen[3] == seen[4] > 0
    own = pieces.codec(pieces.read_model())
    assert sorted(r.token_ids for r in docs.collect()) == sorted(own.processor.encode(texts))
    again = corpus_pipeline.run(spark, sf_dir)
    assert sorted(r.token_ids for r in again.collect()) == sorted(r.token_ids for r in docs.collect())
