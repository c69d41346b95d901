import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from packloom.operators import generate, ranker, vectors
from packloom.session import _shared_folder, cut_lineage

DRAFTS = "sample_key string, prompt string, allowed array<string>, links array<array<string>>, answer string, chain array<string>, confidence double"


def reply(answer, chain, confidence):
    return json.dumps({"answer": answer, "evidence_chain": chain, "confidence": confidence}, ensure_ascii=False)


def route(kind, mode, ids):
    return json.dumps({"route": kind, "evidence_mode": mode, "basis_ids": ids, "requested_target": "x", "reason": ""})


def test_routes_candidates_and_reviews(spark):
    # Replies are told beforehand: workers cannot import this module.
    routes = {"r": route("strict_refusal", "none", []), "b": "{", "u": route("answer", "anchor", ["D009"])}
    usual, replies = route("answer", "anchor", ["D001"]), {"a": reply("甲", ["D001", "D002"], 0.5), "d": reply("甲", ["D009"], 0.5)}

    def router(prompt, limit):
        assert limit == 4096
        return routes.get(prompt[0], usual)

    def reviewer(prompt, limit):
        assert '["D001","D002"]' in prompt
        return replies[prompt[0]]

    ids, links = ["D001", "D002", "D003"], [["D001", "D002"], ["D002", "D003"]]
    rows = [(k, k, ids, links, a, c, None) for k, a, c in [("a", "旧", ["D003"]), ("d", None, None), ("r", "无法确定", []), ("b", "旧", ["D001"]), ("u", "旧", [])]]
    got = {r["sample_key"]: r for r in generate.routed(spark.createDataFrame(rows, DRAFTS), router, reviewer).collect()}
    assert {k: r["decision"] for k, r in got.items()} == {"a": "reviewed", "d": "review_invalid", "r": "consensus", "b": "route_invalid", "u": "route_invalid"}
    assert got["a"]["evidence_chain"] == ["D001", "D002"] and got["a"]["candidates"][0] == ["D003"] and ["D001", "D002"] in got["a"]["candidates"]
    assert got["r"]["answer"] == "无法确定" and got["d"]["answer"] is None


def test_locked_rewrites(spark):
    def model(prompt, limit):
        return {"g": '```json\n{"answer": " 新 "}\n```', "e": '{"answer": " "}', "f": '{"answer": "无法确定"}', "n": '{"answer": 3}'}.get(prompt[0], "nope")

    rows = [(k, k, None, None, "无法确定" if k == "r" else "旧", ["D001"], 0.5) for k in "gefnxr"]
    got = {r["sample_key"]: (r["outcome"], r["answer"], r["evidence_chain"]) for r in generate.rewritten(spark.createDataFrame(rows, DRAFTS), model).collect()}
    assert got == {"g": ("rewritten", "新", ["D001"]), "r": ("refusal", "无法确定", ["D001"])} | {k: ("kept", "旧", ["D001"]) for k in "efnx"}


def test_stand_in_makes_rounds_and_errors(spark):
    df = spark.createDataFrame([(str(i), f"{'D001' if i % 3 else 'x'} {i}", ["D001"]) for i in range(60)], "sample_key string, prompt string, allowed array<string>")
    got = generate.generate(df, generate.mock_model).toPandas()
    assert set(got.rounds) == {1, 2} and (got.error == "").all() and len(got) == 60
    assert generate.generate(df.limit(0), generate.mock_model).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([(1, "ab", "x"), (2, "", "x"), (3, None, "x"), (4, "ab" * 9000, "x")], "id int, t string, vector string")
    got = {r["id"]: r["vector"] for r in vectors.encoded(df, "t", vectors.character_encoder).collect()}
    assert got[2] is None and got[3] is None and np.allclose(got[1], got[4]) and abs(np.linalg.norm(got[1]) - 1) < 1e-9
    q = spark.createDataFrame([("s", "p", "ab"), ("u", None, "ab")], "sample_key string, pack string, question string")
    t = spark.createDataFrame([("p", "D001", "ba"), ("p", "D002", None), ("q", "D003", "ab")], "pack string, event_id string, text string")
    assert {tuple(r) for r in vectors.pack_cosines(q, t, vectors.character_encoder).select("sample_key", "event_id", F.round("cosine", 6)).collect()} == {("s", "D001", 1.0), ("s", "D002", 0.0)}


def test_ablated_inputs(spark):
    df = spark.createDataFrame([("s", "D001", *[1.0] * len(ranker.NUMERIC))], "sample_key string, event_id string, " + ", ".join(f"{n} double" for n in ranker.NUMERIC))
    row = ranker.ablated(df, "id_position_and_type").first()
    assert {n for n in ranker.NUMERIC if row[n] == 0} == {"anchor", "number", *ranker.KINDS} and len(ranker.NUMERIC) == 16
    with pytest.raises(KeyError):
        ranker.ablated(df, "other")


def test_lineage_is_cut_in_the_shared_folder(spark):
    assert cut_lineage(spark.range(3)).count() == 3 and _shared_folder(spark)
