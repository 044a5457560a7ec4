"""Tables that grow with the documents aren't sent through the driver: no join of them is a broadcast, however small the tables."""

import pytest

import corpus_pipeline
from lodestack.llm import common, exact_dedup, mixing, simhash

ROWS = [(i, f"word{i % 7} of some text {i % 3}", f"s{i % 4}") for i in range(30)]


@pytest.fixture
def plans(monkeypatch):
    """The plans of all that is kept, and of what is passed to it."""
    seen = []

    def noted(df):
        seen.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    for module in (common, exact_dedup, mixing, simhash):
        monkeypatch.setattr(module, "keep", lambda df, name, keep=module.keep: keep(noted(df), name))
    # no table counts as one of few rows
    monkeypatch.setattr(common, "SENT_ROWS", -1, raising=False)
    noted.seen = seen
    return noted


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string, source string")


def test_simhash_sends_no_growing_table(spark, plans):
    plans(simhash.near_duplicates(docs(spark)))
    assert len(plans.seen) > 5 and not [p for p in plans.seen if "Broadcast" in p]


@pytest.mark.parametrize("stage", [corpus_pipeline.dedup_exact, corpus_pipeline.dedup_near, corpus_pipeline.mix_sources])
def test_pipeline_stages_send_no_growing_table(spark, plans, stage):
    plans(stage(spark, docs(spark), ""))
    assert len(plans.seen) > 2 and not [p for p in plans.seen if "Broadcast" in p]
