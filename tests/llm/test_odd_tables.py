"""Every query over odd, empty and clashing tables: one row per document, no crash, defined values."""

import pytest

from isopycna.llm import catalogue

from . import oddities

NAMES = sorted(n for n in catalogue.QUERIES if n != "op1_embeddings")
BY_DOCUMENT = [n for n in NAMES if n != "op12_divergence"]


@pytest.mark.parametrize("name", BY_DOCUMENT)
def test_odd(spark, tmp_path, name):
    d = oddities.stored(spark, tmp_path, oddities.clashing(spark))
    rows = catalogue.QUERIES[name](spark, d).collect()
    assert len(rows) == len(oddities.ROWS)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in rows) == sorted((x[0] is None, x[0] or 0) for x in oddities.ROWS)


@pytest.mark.parametrize("name", NAMES)
def test_empty(spark, tmp_path, name):
    d = oddities.stored(spark, tmp_path, oddities.empty(spark), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert catalogue.QUERIES[name](spark, d).collect() == []


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = oddities.stored(spark, tmp_path, oddities.clashing(spark))
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in rows} <= {x[0] for x in oddities.ROWS}
    docs = oddities.clashing(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert tuple(out.columns) == corpus_pipeline.COLUMNS, name
    none = oddities.stored(spark, tmp_path / "none", oddities.empty(spark))
    assert corpus_pipeline.run(spark, none).collect() == []
