import __spark_entry__ as entry
import corpus_pipeline
import pytest

from halfstar.llm.queries import QUERIES


@pytest.mark.parametrize("n", range(1, 14))
def test_one_query_each(n):
    assert len([q for q in entry.queries() if q.startswith(f"op{n}_")]) == 1


def test_pipeline(spark, sf):
    assert set(QUERIES) < set(entry.queries()) and "pipeline" in entry.queries()
    out = corpus_pipeline.run(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.count() and out.join(docs, "doc_id", "left_anti").count() == 0
    assert {r[0] for r in out.select("source").distinct().collect()} <= {r[0] for r in docs.select("source").distinct().collect()}


def test_stages_keep_the_columns(spark, sf, hard_docs, tmp_path):
    for docs in (hard_docs, hard_docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns, name
            out.count()
