"""Dealt queries with SQL against it, and all of them on the driver's tables."""

from __future__ import annotations

import os

import pytest

from vinculum.llm.catalog import ORACLES, QUERIES
from workload.check import compare

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables not present")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    problem, _ = compare(spark, SF_DIR, QUERIES[name], ORACLES[name])
    assert not problem


def held_out(spark, name, column):
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet").toPandas()
    out = QUERIES[name](spark, SF_DIR).toPandas().merge(labels, on="doc_id")
    return out[out["held_out"]], column


@pytest.mark.parametrize(("name", "column"), [("op5_quality_classifier", "quality"), ("op9_toxicity", "toxic")])
def test_held_out_accuracy(spark, name, column):
    out, _ = held_out(spark, name, column)
    assert len(out) and (out["predicted"] == out[column]).mean() >= 0.85


def test_held_out_language(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas()
    out = QUERIES["op8_language_id"](spark, SF_DIR).toPandas().merge(docs, on="doc_id")
    out = out[out["held_out"]]
    assert (out["lang_pred"] == out["lang"]).mean() >= 0.97


def test_pipeline_against_its_stages_by_hand(spark):
    """Each stage's decisions, recomputed in plain Python on what the stage before kept."""
    import corpus_pipeline
    from test_corpus import linked

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    benchmark = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.write_through(stage(spark, docs, SF_DIR), "stage")
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        kept.append({r.doc_id: r for r in docs.collect()})
    good, one, clean, masked = kept
    verdicts = {r.doc_id: r.kept for r in QUERIES["op1_quality_rules"](spark, SF_DIR).collect()}
    assert set(good) == {k for k, v in verdicts.items() if v}
    rows = sorted((k, r.text) for k, r in good.items())
    assert set(one) == {key for key, _, component, _ in linked(rows, 5, 80) if key == component}
    assert set(one) - set(clean) == {k for k, r in one.items() if any(item in r.text for item in benchmark)}
    assert set(masked) == set(clean) and all(r.n_chars == len(r.text) for r in masked.values())
    packed = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert set(packed["doc_id"]) == set(masked)
    assert (packed.groupby("sequence_id")["length"].sum() <= 4096).all()
