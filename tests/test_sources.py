import json

import pytest
from pyspark.sql import functions as F

from packloom.sources import packs, sinks


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    base = tmp_path_factory.mktemp("packs")
    for track, name in (("A", "域_0000001"), ("train", "域_0000002")):
        d = base / track / name
        (d / "gold").mkdir(parents=True)
        (d / "D001.txt").write_text("第一篇。\n第二行", encoding="utf-8")
        (d / "D002.txt").write_text("", encoding="utf-8")
        (d / "notes.txt").write_text("x")
        (d / packs.QUESTIONS_FILE).write_text(json.dumps([{"sample_id": f"{track}1", "question_type": "retrospective", "question": "问"}, {"sample_id": f"{track}1", "question_type": "", "question": "问"}], ensure_ascii=False), encoding="utf-8")
    a = base / "A" / "域_0000001"
    (a / packs.EVENTS_FILE).write_text(json.dumps([{"event_id": "D001", "argument": {"主体": "甲", "数": 3}}, {"event_id": "D002", "argument": "直说"}, {"event_id": "D003"}], ensure_ascii=False), encoding="utf-8")
    (a / packs.EDGES_FILE).write_text(json.dumps([{"cause_event_id": "D001", "effect_event_id": "D002"}]), encoding="utf-8")
    (a / "gold" / packs.GOLD_FILE).write_text(json.dumps([{"sample_id": "A1", "answer": "甲", "answer_facts": {"required_facts": ["f", {"fact": "g"}]}}, {"sample_id": "A2", "answers": ["x", 1], "evidence_chains": [["D001"], []]}], ensure_ascii=False), encoding="utf-8")
    return str(base)


def test_pack_folders(spark, root):
    docs = {(r["pack"], r["doc_code"]): (r["track"], r["text"]) for r in packs.read_documents(spark, root).collect()}
    assert docs[("域_0000001", "D001")] == ("A", "第一篇。\n第二行") and docs[("域_0000002", "D001")][0] == "train" and len(docs) in (2, 4)
    ev = {r["event_id"]: r["argument"] for r in packs.read_events(spark, root).collect()}
    assert ev == {"D001": {"主体": "甲", "数": "3"}, "D002": {"": "直说"}, "D003": None}
    assert [(r["pos"], r["cause_event_id"], r["effect_event_id"], r["result_event_id"]) for r in packs.read_edges(spark, root).collect()] == [(0, "D001", "D002", None)]
    q = packs.read_questions(spark, root)
    assert q.count() == 4 and packs.read_questions(spark, root, "train").count() == 2
    assert {tuple(r)[1:] for r in packs.question_violations(q).collect()} == {(0, "A1", "repeated"), (1, "A1", "repeated"), (1, "A1", "blank"), (0, "train1", "repeated"), (1, "train1", "repeated"), (1, "train1", "blank")}


def test_gold_is_normalised(spark, root):
    g = {r["sample_id"]: r for r in packs.read_gold(spark, root).collect()}
    assert g["A1"]["pack"] == "域_0000001" and g["A1"]["answers"] == ["甲"] and g["A1"]["required_facts"] == ["f", "g"] and g["A1"]["evidence_chains"] == []
    assert g["A2"]["answers"] == ["x"] and g["A2"]["evidence_chains"] == [["D001"], []]


def test_lines_and_partitions(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"a": 1}\nbroken\n')
    got = packs.read_lines(spark, str(f), "a int").collect()
    assert sorted((r["a"] or 0, r["_corrupt"]) for r in got)[1] == (1, None) and sum(r["_corrupt"] is not None for r in got) == 1
    sinks.write_lines(spark.createDataFrame([("fit", "A", None)], "split string, view string, x string"), str(tmp_path / "out"), ["split", "view"])
    assert [p.read_text().strip() for p in (tmp_path / "out/split=fit/view=A").glob("*.json")] == ['{"x":null}']
    sinks.write_json({"a": "甲"}, str(tmp_path / "d/m.json"))
    assert json.loads((tmp_path / "d/m.json").read_text()) == {"a": "甲"}
    sinks.write_json({"b": 2}, str(tmp_path / "d/m.json"))
    assert json.loads((tmp_path / "d/m.json").read_text()) == {"b": 2}
    assert [p.name for p in (tmp_path / "d").iterdir() if not p.name.endswith(".crc")] == ["m.json"]


def test_invalid_results_are_done_again(spark, tmp_path):
    items = spark.createDataFrame([("a",), ("b",)], "k string")
    store = sinks.ResultStore(spark, str(tmp_path / "v"), "k", {}, F.col("v") > 0)
    store.append(spark.createDataFrame([("a", 1), ("b", -1)], "k string, v int"))
    assert [r["k"] for r in store.open_items(items).collect()] == ["b"]
    store.append(spark.createDataFrame([("b", 3)], "k string, v int"))
    assert sorted(map(tuple, store.finish(items).collect())) == [("a", 1), ("b", 3)]


def test_results_resume(spark, tmp_path):
    items = spark.createDataFrame([("a",), ("b",)], "k string")
    store = sinks.ResultStore(spark, str(tmp_path / "s"), "k", {"v": 1})
    assert store.open_items(items).count() == 2
    store.append(spark.createDataFrame([("a", 1)], "k string, v int"))
    again = sinks.ResultStore(spark, str(tmp_path / "s"), "k", {"v": 1})
    assert [r["k"] for r in again.open_items(items).collect()] == ["b"]
    with pytest.raises(ValueError, match="missing"):
        again.finish(items)
    again.append(spark.createDataFrame([("b", 2)], "k string, v int"))
    assert again.finish(items).count() == 2
    with pytest.raises(ValueError, match="signature"):
        sinks.ResultStore(spark, str(tmp_path / "s"), "k", {"v": 2})
    cache = spark.createDataFrame([], "digest string")
    assert sinks.missing_from_cache(spark.createDataFrame([("x",), ("x",), (None,)], "t string"), "t", cache).count() == 1


def test_views(spark):
    a, b, c = spark.range(2), spark.range(3), spark.range(4)
    assert [x.count() for x in packs.view(a, b, c, "A")] == [2, 3, 4] and [x.count() for x in packs.view(a, b, c, "B")] == [2, 3, 0] and [x.count() for x in packs.view(a, b, c, "C")] == [2, 0, 0]
