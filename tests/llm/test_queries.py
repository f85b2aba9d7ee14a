"""The registered queries and the pipeline on the smallest tables."""

import corpus_pipeline
import pytest
from tabloom.llm import queries
from tests.compare import compare, duck


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, folder, name):
    assert compare(queries.QUERIES[name](spark, folder), duck(folder), queries.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_gives_rows(spark, folder, name):
    rows = queries.QUERIES[name](spark, folder).collect()
    assert rows if "graph" not in name else rows is not None


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = corpus_pipeline.run(spark, folder).collect()
    assert 0 < len({r.doc_id for r in rows}) < docs.count()
