import itertools
import json
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packloom.operators import checks, contract, dataset, graph, metrics, retrieval
from packloom.operators.generate import generate
from packloom.operators.skew import salted_join
from packloom.sources import relations


def test_bm25_against_the_formula(spark):
    texts = {"a": {1: "内涝 内涝 水位", 2: "水位 上涨", 3: ""}, "b": {1: "storm storm flood"}}
    queries = {"q1": ("a", "内涝水位"), "q2": ("b", "flood flood x"), "q3": ("a", "")}

    def toks(t):
        import re

        raw = re.findall(r"[A-Za-z0-9_]+|[一-鿿]", t.lower())
        return raw + [x + y for x, y in zip(raw, raw[1:]) if len(x) == len(y) == 1]

    want = {}
    for q, (c, text) in queries.items():
        docs = {i: Counter(toks(t)) for i, t in texts[c].items()}
        mean = sum(sum(d.values()) for d in docs.values()) / len(docs)
        for i, d in docs.items():
            s = 0.0
            for term in set(toks(text)):
                n = sum(term in x for x in docs.values())
                if d[term]:
                    s += math.log(1 + (len(docs) - n + 0.5) / (n + 0.5)) * d[term] * 2.2 / (d[term] + 1.2 * (0.25 + 0.75 * sum(d.values()) / mean))
            if s:
                want[q, i] = s
    t = spark.createDataFrame([(c, i, x) for c, d in texts.items() for i, x in d.items()], "corpus string, item int, text string")
    q = spark.createDataFrame([(k, c, x) for k, (c, x) in queries.items()], "query string, corpus string, text string")
    got = {(r["query"], r["item"]): r["score"] for r in retrieval.bm25(q, t).collect()}
    assert got == pytest.approx(want)
    assert retrieval.bm25(q.limit(0), t.limit(0)).count() == 0


def test_nothing_that_grows_is_broadcast(spark, tmp_path):
    spark.createDataFrame([("q1", "a", "内涝水位"), ("q2", "b", "flood")], "query string, corpus string, text string").write.parquet(f"{tmp_path}/q")
    spark.createDataFrame([("a", 1, "内涝"), ("b", 2, "storm flood")], "corpus string, item int, text string").write.parquet(f"{tmp_path}/t")
    sf = "/root/testdata/sf0.001"
    scores = retrieval.bm25(spark.read.parquet(f"{tmp_path}/q"), spark.read.parquet(f"{tmp_path}/t"), [])
    for df in (scores, relations.edges(spark, sf), relations.candidates(spark, sf), relations.questions(spark, sf).join(relations.candidates(spark, sf), "pack")):
        assert "Broadcast" not in df._jdf.queryExecution().sparkPlan().toString()
    assert {r["query"] for r in scores.collect()} == {"q1", "q2"}


def test_paths_are_never_broadcast(spark, tmp_path):
    spark.createDataFrame([("a", "D001"), ("a", "D002")], "pack string, event_id string").write.parquet(f"{tmp_path}/n")
    spark.createDataFrame([("a", "D001", "D002")], "pack string, src string, dst string").write.parquet(f"{tmp_path}/e")
    paths = graph.simple_paths(spark.read.parquet(f"{tmp_path}/n"), spark.read.parquet(f"{tmp_path}/e"))
    # The asking side has lost its hint in a join, so the paths' own must hold.
    joined = spark.createDataFrame([("q", "a")], "sample_key string, pack string").join(paths, "pack")
    assert "Broadcast" not in joined._jdf.queryExecution().sparkPlan().toString()
    assert sorted(r["path"] for r in joined.collect()) == [["D001"], ["D001", "D002"], ["D002"]]


def test_budget_skips_but_goes_on(spark):
    df = spark.createDataFrame([(["aaaa", "bbbbbb", "aaaa", "cc"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(retrieval.within_budget(F.col("t"), 7)).collect()] == [["aaaa", "cc"], []]


def brute_paths(nodes, edges):
    out = {(n,) for n in nodes}
    front = set(out)
    while front:
        front = {p + (b,) for p in front for a, b in edges if a == p[-1] and b not in p}
        out |= front
    return out


def test_paths_against_brute_force_and_the_cap(spark):
    rng = random.Random(1)
    nodes, rows = [f"D{i:03d}" for i in range(7)], []
    for pack in "xy":
        rows += [(pack, *rng.sample(nodes, 2)) for _ in range(10)]
    e = spark.createDataFrame(rows + rows[:3], "pack string, src string, dst string")
    n = spark.createDataFrame([(p, x) for p in "xyz" for x in nodes], "pack string, event_id string")
    got = {(r["pack"], tuple(r["path"])) for r in graph.simple_paths(n, e).collect()}
    want = {(p, path) for p in "xyz" for path in brute_paths(nodes, {(a, b) for q, a, b in rows if q == p})}
    assert got == want
    with pytest.raises(ValueError, match="paths"):
        graph.simple_paths(n, e, most_paths=7)
    assert graph.simple_paths(n.limit(0), e.limit(0)).count() == 0


def test_paths_have_no_bound_of_length_unless_asked(spark):
    nodes = [f"D{i:03d}" for i in range(16)]
    n = spark.createDataFrame([("x", x) for x in nodes], "pack string, event_id string")
    e = spark.createDataFrame([("x", a, b) for a, b in zip(nodes, nodes[1:])], "pack string, src string, dst string")
    got = {tuple(r["path"]) for r in graph.simple_paths(n, e).collect()}
    assert got == brute_paths(nodes, set(zip(nodes, nodes[1:]))) and max(map(len, got)) == 16
    assert {tuple(r["path"]) for r in graph.simple_paths(n, e, 12).collect()} == {p for p in got if len(p) <= 12}


def test_diversity_is_greedy_with_its_ties(spark):
    paths = [(["D001", "D002"], 1.0), (["D001", "D002", "D003"], 1.0), (["D004"], 0.9), (["D005"], 0.9)]
    df = spark.createDataFrame([("s", p, s) for p, s in paths], "sample_key string, path array<string>, score double")
    got = [r["path"] for r in graph.diverse_paths(df, 4).orderBy("rnk").collect()]
    assert got == ["D001>D002", "D005", "D004", "D001>D002>D003"]


def test_chain_candidates_against_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, [f"D{x:03d}" for x in rng.sample(range(9), n)], ["D008"], [["D008", "D007"], ["D001", "D002"]]) for i, n in enumerate([0, 1, 2, 3, 4, 5])]
    df = spark.createDataFrame(rows, "i int, c array<string>, a array<string>, e array<array<string>>")
    got = {r["i"]: [tuple(x) for x in r["x"]] for r in df.select("i", graph.chain_candidates(F.col("c"), F.col("a"), F.col("e"), 400).alias("x")).collect()}
    for i, c, a, e in rows:
        want = {tuple(c)} | {tuple(c[x:y]) for x in range(len(c)) for y in range(x + 1, len(c) + 1)} | {("D008",), ("D008", "D007")}
        if 3 <= len(c) <= 7:
            want |= {p for k in range(2, len(c)) for p in itertools.combinations(c, k)}
        assert set(got[i]) == {x for x in want if x} and len(got[i]) == len(set(got[i]))
        assert not c or got[i][0] == tuple(c)
    limited = df.select(F.size(graph.chain_candidates(F.col("c"), F.col("a"), F.col("e"))).alias("n")).collect()
    assert max(r["n"] for r in limited) == 16


def test_char_f1(spark):
    rng = random.Random(3)
    rows = [("".join(rng.choice("ab一二 。") for _ in range(rng.randrange(9))), "".join(rng.choice("aB一二 。") for _ in range(rng.randrange(9)))) for _ in range(80)] + [(None, "a"), ("", "")]
    got = [r["f1"] for r in metrics.char_f1(spark.createDataFrame(rows, "a string, b string"), "a", "b").collect()]

    def f1(a, b):
        x, y = (Counter(c for c in (t or "").lower() if c.isalnum()) for t in (a, b))
        return float(not x and not y) if not x or not y else 2 * sum((x & y).values()) / (sum(x.values()) + sum(y.values()))

    assert got == pytest.approx([f1(a, b) for a, b in rows])


def test_alternatives(spark):
    df = spark.createDataFrame([(["a", "b"], [["a", "b", "c"], ["b"]]), ([], []), (["a"], [])], "c array<string>, g array<array<string>>")
    m = metrics.best_alternative(F.col("c"), F.col("g"))
    got = [x for r in df.select(m["exact"], m["node_f1"], m["edge_f1"]).collect() for x in r]
    assert got == pytest.approx([0.0, 0.8, 2 / 3, 1.0, 1.0, 1.0, 0.0, 0.0, 1.0])


def test_bootstrap_over_chunks_has_the_spread_of_the_mean(spark):
    rng = random.Random(5)
    rows = [(f"k{i}", s, rng.gauss(m, 1.0)) for s, m in (("a", 0.0), ("b", 3.0)) for i in range(300)] + [("one", "c", 2.0)]
    df = spark.createDataFrame(rows, "k string, s string, v double")
    got = metrics.bootstrap_means(df, "k", "v", 10_000, 3, "s", chunk=64).toPandas()
    for s, n in (("a", 300), ("b", 300), ("c", 1)):
        g, v = got[got.stratum == s], [x for _, t, x in rows if t == s]
        m, mean = (g.total / g.n).sort_values().tolist(), sum(v) / n
        assert sorted(g.rep) == list(range(10_000)) and set(g.n) == {n}
        sd = (sum((x - mean) ** 2 for x in v) / n) ** 0.5 / n**0.5
        assert abs(m[250] - (mean - 1.96 * sd)) <= 0.1 * sd and abs(m[9750] - (mean + 1.96 * sd)) <= 0.1 * sd


def test_nearest_rank_and_numbers(spark):
    values = [random.Random(4).randrange(50) for _ in range(101)]
    df = spark.createDataFrame([("g", v) for v in values] + [("h", None)], "g string, v int")
    got = {r["percent"]: r["value"] for r in metrics.nearest_rank(df, "g", "v", [0, 50, 90, 99, 100]).collect()}
    assert got == {p: sorted(values)[round(100 * p / 100)] for p in (0, 50, 90, 99, 100)}
    n = metrics.numbered_rows(spark.range(1000), "id")
    assert sorted(r["number"] for r in n.collect()) == list(range(1000))


ALLOWED = ["D001", "D002"]
REPLIES = [
    ('{"answer": "甲", "evidence_chain": ["D001"], "confidence": 0.5}', ""),
    ('```json\n{"answer": "甲", "evidence_chain": ["D001"], "confidence": 1}\n```', ""),
    ("nope", "not_json"),
    ("[]", "not_object"),
    ('{"answer": " ", "evidence_chain": []}', "answer_blank"),
    ('{"answer": 3, "evidence_chain": []}', "answer_blank"),
    ('{"answer": "甲", "evidence_chain": "D001"}', "chain_not_ids"),
    ('{"answer": "甲", "evidence_chain": ["D001", null]}', "chain_not_ids"),
    ('{"answer": "甲", "evidence_chain": ["D001", 2]}', "chain_not_ids"),
    ('{"answer": "甲", "evidence_chain": ["D009"]}', "unknown_id"),
    ('{"answer": "甲", "evidence_chain": ["D001", "D001"]}', "repeated_id"),
    ('{"answer": "无法确定", "evidence_chain": ["D001"], "confidence": 0.4}', ""),
    ('{"answer": "无法回答，资料不足", "evidence_chain": [], "confidence": 0.4}', ""),
    ('{"answer": "甲", "evidence_chain": [], "confidence": 0.4}', "no_chain"),
    ('{"answer": "甲", "evidence_chain": ["D001"], "confidence": true}', "confidence_type"),
    ('{"answer": "甲", "evidence_chain": ["D001"]}', "confidence_type"),
    ('{"answer": "甲", "evidence_chain": ["D001"], "confidence": 1.5}', "confidence_range"),
]


def test_reply_contract(spark):
    df = spark.createDataFrame([(r, w, ALLOWED) for r, w in REPLIES], "r string, w string, a array<string>")
    for x in df.select("r", "w", contract.prediction_error(F.col("r"), F.col("a")).alias("e")).collect():
        assert x["e"] == x["w"], x["r"]
    assert df.limit(0).select(contract.prediction_error(F.col("r"), F.col("a"))).count() == 0


def test_refusal_tags_and_two_fields(spark):
    rows = [
        ('{"answer": "无法确定", "evidence_chain": [], "confidence": null}', None),
        ('{"answer": "无法确定 ", "evidence_chain": ["D001"]}', "exact_refusal_fields"),
        ('{"answer": "不能确定，见 D003 所述", "evidence_chain": []}', None),
        ('{"answer": "证据不足以确定原因", "evidence_chain": []}', "empty_chain_refusal_phrase"),
        ('{"answer": "证据不足以确定原因", "evidence_chain": ["D001"]}', None),
        ("broken", None),
        (None, None),
    ]
    df = spark.createDataFrame(rows, "r string, w string")
    assert all(x[0] == x["w"] for x in df.select(contract.refusal_tag(F.col("r")), "w").collect())
    two = [
        ('<think>a</think>{"answer": "甲", "evidence_chain": ["D001"]}', ""),
        ('<think>a {"answer": "甲", "evidence_chain": ["D001"]}', "thinking_open"),
        ('{"answer": "甲", "evidence_chain": ["D001"], "confidence": 1}', "other_fields"),
        ('{"answer": "无法确定", "evidence_chain": ["D001"]}', "refusal_fields"),
    ]
    df = spark.createDataFrame([(r, w, ALLOWED) for r, w in two], "r string, w string, a array<string>")
    assert all(x[0] == x["w"] for x in df.select(contract.two_field_error(F.col("r"), F.col("a")), "w").collect())


def test_routes_and_polymorphic_fields(spark):
    good = {"route": "answer", "evidence_mode": "path", "basis_ids": ["D001"], "requested_target": "x", "reason": ""}
    cases = [({}, ""), ({"route": "x"}, "route"), ({"evidence_mode": None}, "evidence_mode"), ({"basis_ids": ["D009"]}, "basis_ids"), ({"basis_ids": ["D001", "D001"]}, "repeated_basis"), ({"route": "strict_refusal"}, "refusal_with_evidence"), ({"evidence_mode": "none"}, "answer_without_evidence"), ({"requested_target": " "}, "target"), ({"reason": None}, "reason")]
    df = spark.createDataFrame([(json.dumps(good | c), w, ALLOWED) for c, w in cases], "r string, w string, a array<string>")
    for x in df.select("r", "w", contract.route_error(F.col("r"), F.col("a")).alias("e")).collect():
        assert x["e"] == x["w"], x["r"]
    v = spark.createDataFrame([('"a"', ["a"], []), ('["a", 1, {"fact": "b"}, {"text": "c"}, {}]', ["a"], ["a", "b", "c", ""]), ("3", [], [])], "j string, t array<string>, f array<string>")
    for x in v.select(contract.text_or_list(F.parse_json("j")).alias("x"), contract.facts(F.parse_json("j")).alias("y"), "t", "f").collect():
        assert x["x"] == x["t"] and x["y"] == x["f"]


def test_endpoints_and_secrets(spark):
    df = spark.createDataFrame([("https://h/v1", ""), ("ftp://h", "scheme"), ("https://u:p@h/", "user"), ("https://h/?k=1", "query"), ("nothing", "scheme")], "u string, w string")
    assert all(x[0] == x["w"] for x in df.select(contract.endpoint_error(F.col("u")), "w").collect())
    t = spark.createDataFrame([("key abc, Authorization: Bearer x.y-z",)], "t string")
    assert t.select(contract.redacted(F.col("t"), F.lit("abc"))).first()[0] == "key [redacted], Authorization: Bearer [redacted]"


def test_split_keeps_groups_and_shares(spark):
    rows = [("d", f"g{i}", 1 + i % 3) for i in range(400)] + [("e", "only", 5)]
    got = dataset.digest_order_split(spark.createDataFrame(rows, "domain string, grp string, size int"), 3).toPandas()
    d = got[got.domain == "d"].groupby("split_name")["size"].sum()
    total = sum(s for x, _, s in rows if x == "d")
    assert len(got) == 401 and abs(d["fit"] / total - 0.8) < 0.01 and abs(d["validation"] / total - 0.1) < 0.01
    assert got[got.domain == "e"].split_name.tolist() == ["fit"]


def test_views_masks_and_quotas(spark):
    df = spark.createDataFrame([(["A", "C"], x / 100) for x in range(100)] + [([], 0.5)], "v array<string>, d double")
    got = [r[0] for r in df.select(dataset.weighted_view(F.col("v"), {"A": 0.6, "B": 0.3, "C": 0.1}, F.col("d"))).collect()]
    assert got[-1] is None and set(got[:-1]) == {"A", "C"} and 84 <= got.count("A") <= 87
    m = spark.createDataFrame([([1, 2], [1, 2, 3, 4]), ([], [5])], "p array<int>, w array<int>")
    assert [r[0] for r in m.select(dataset.label_mask(F.col("p"), F.col("w"))).collect()] == [[-100, -100, 3, 4], [5]]
    q = spark.createDataFrame([("s", f"p{i % 4}", f"k{i}") for i in range(40)], "s string, o string, k string")
    first = dataset.quota_sample(q, "s", "o", "k", 4, 1).toPandas()
    assert len(first) == 4 and first.o.nunique() == 4


def test_checks(spark):
    a, b = spark.createDataFrame([("x",), ("y",), ("y",)], "k string"), spark.createDataFrame([("y",), ("z",)], "k string")
    assert {tuple(r) for r in checks.coverage(a, b, ["k"]).collect()} == {("x", True, False), ("y", False, False), ("z", False, True)}
    assert {tuple(r) for r in checks.violations(a, b, "k").collect()} == {("x", "unknown"), ("y", "repeated")}
    assert tuple(checks.same_sets(a, a).first()) == (0, 0) and tuple(checks.same_sets(a, b).first()) == (2, 1)


def test_hot_keys_are_split_without_losing_rows(spark):
    left = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500)).alias("k"), F.when(F.col("id") % 7 == 0, None).otherwise("k").alias("x"))
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(400)], "k string, v int")
    for how in ("left", "inner"):
        assert salted_join(left, right, "k", ["id"], how).count() == left.join(right, "k", how).count()


def test_generation_retries_and_refuses(spark):
    def model(prompt, limit):
        if "boom" in prompt:
            raise RuntimeError
        if prompt.startswith("late") and "not_json" not in prompt:
            return "nope"
        return json.dumps({"answer": "甲", "evidence_chain": ["D001"], "confidence": 0.5})

    df = spark.createDataFrame([("a", "ok", ["D001"]), ("b", "late", ["D001"]), ("c", "ok", []), ("d", "boom", ["D001"])], "sample_key string, prompt string, allowed array<string>")
    got = {r["sample_key"]: (r["rounds"], r["error"], r["answer"]) for r in generate(df, model).collect()}
    assert got == {"a": (1, "", "甲"), "b": (2, "", "甲"), "c": (2, "unknown_id", "无法确定"), "d": (2, "model: RuntimeError", "无法确定")}
