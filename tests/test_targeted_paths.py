"""Targeted paths by words that only the later parts of texts have, and their scores against SQL over whole texts."""

import re
from pathlib import Path

import pytest

from packloom.operators import graph
from packloom.plans.graph_queries import SCORED
from packloom.plans.sql import base

DATA = Path("/root/testdata/sf0.001")

SCHEMAS = {
    "documents": "doc_id bigint, text string, pack string, doc_code string",
    "case_events": "pack string, pos int, event_id string, doc_id string, event_type string, trigger_word string, argument map<string,string>",
    "edges": "pack string, pos int, cause_event_id string, result_event_id string, effect_event_id string, causal_type string, relation_type string, confidence_level string",
    "questions": "pack string, track string, pos int, sample_id string, question_type string, question string, reasoning_type string",
}


def test_whole_texts_count(spark, tmp_path):
    rows = {
        "documents": [(1, "无关。" * 200 + "泵站内涝", "p_1", "D001"), (2, "无关。", "p_1", "D002"), (3, "无关。", "p_1", "D003")],
        "case_events": [("p_1", i, f"D00{i}", None, "事件", None, {"影响": "平常" * 300 + "桥梁垮塌"} if i == 2 else None) for i in (1, 2, 3)],
        "edges": [("p_1", 0, "D009", "D009", None, None, None, None)],
        "questions": [("p_1", "A", 0, "text", "unanswerable", "哪里内涝", None), ("p_1", "A", 1, "argument", "unanswerable", "何处垮塌", None)],
    }
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(rows[name], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r["sample_key"], r["rnk"]): r["path"] for r in graph.targeted_paths(spark, str(tmp_path)).collect()}
    assert got["text", 1] == "D001" and got["argument", 1] == "D002" and len(got) == 6


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_scores_of_whole_texts_equal_the_sql_without_its_cut(spark):
    import duckdb

    sql, cuts = re.subn(r", 400\)", ", 1000000000)", base("SELECT sample_key, array_to_string(path, '>'), score FROM scored1", SCORED))
    assert cuts == 2
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    want = {(k, p): s for k, p, s in con.sql(sql).fetchall()}
    got = {(r[0], r[1]): r[2] for r in graph.scored_paths(spark, str(DATA), None).select("sample_key", graph.joined("path"), "score").collect()}
    cut = {(r[0], r[1]): r[2] for r in graph.scored_paths(spark, str(DATA)).select("sample_key", graph.joined("path"), "score").collect()}
    assert got == pytest.approx(want, abs=1e-6) and cut.keys() == got.keys() and cut != got
