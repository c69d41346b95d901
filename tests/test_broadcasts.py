"""Queries over the scores and paths of all questions: none of their joins is planned as a broadcast, however small the tables."""

from pathlib import Path

import pytest

from packloom.plans import catalog

DATA = Path("/root/testdata/sf0.001")
NAMES = ["evidence_sentences", "hybrid_rank", "ranking_features", "ranker_inputs", "rag_documents", "recall_at_k_by_group", "hints_union_anchors", "guided_prompt", "miss_classification", "hybrid_vectors", "candidate_recall", "numbered_candidates"]


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_no_join_is_planned_as_a_broadcast(spark, monkeypatch, name):
    frame, plans = type(spark.range(1)), []
    cut = frame.checkpoint
    monkeypatch.setattr(frame, "checkpoint", lambda df, eager=True: plans.append(df) or cut(df, eager))
    plans.append(catalog.queries()[name](spark, str(DATA)))
    assert len(plans) > 1
    assert [p for p in plans if "Broadcast" in p._jdf.queryExecution().sparkPlan().toString()] == []
