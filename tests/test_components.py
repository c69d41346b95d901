import random

from pyspark.sql import functions as F

from packloom.operators.components import propagate
from packloom.operators.ranker import NUMERIC, fit, rank, thresholds


def union_find(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for r, e in rows:
        a, b = find((0, r)), find((1, e))
        if a != b:
            parent[a] = b
    groups = {}
    for r, _ in rows:
        groups.setdefault(find((0, r)), set()).add(r)
    return {r: min(g) for g in groups.values() for r in g}


def test_random_graphs_with_a_hot_entity(spark):
    rng = random.Random(12)
    rows = {(f"r{rng.randrange(400):03d}", b"e%d" % rng.randrange(500)) for _ in range(420)}
    rows |= {(f"z{i:03d}", b"hot") for i in range(200)} | {(f"c{i // 2 + i % 2:03d}", b"k%d" % (i // 2)) for i in range(80)}
    df = spark.createDataFrame(sorted(rows), "record string, entity binary").repartition(6)
    assert {r[0]: r[1] for r in propagate(df).collect()} == union_find(rows)
    assert propagate(df.limit(0)).count() == 0


def test_ranker_learns_an_obvious_rule(spark):
    rng = random.Random(1)
    rows = []
    for s in range(60):
        good = rng.randrange(4)
        for i in range(4):
            rows.append((f"s{s}", f"D{i}", *[float(i == good) if n == "anchor" else float(i + 1) if n == "place" else rng.random() for n in NUMERIC]))
    df = spark.createDataFrame(rows, "sample_key string, event_id string, " + ", ".join(f"{n} double" for n in NUMERIC))
    labels = df.where("anchor = 1").select("sample_key", "event_id")
    top = rank(fit(df, labels, rounds=3), df).where("rnk = 1").select("sample_key", "event_id")
    assert top.exceptAll(labels).count() == 0 and top.count() == 60


def test_ranker_is_fitted_on_all_rows(spark):
    # Of 400 000 rows four are true, each told by an input of its own; a sample of rows or of thresholds leaves some out.
    true = {"relevance": 77_777, "anchor": 177_778, "label_overlap": 277_779, "number": 377_780}
    df = spark.range(400_000).select(F.concat(F.lit("s"), "id").alias("sample_key"), F.lit("D001").alias("event_id"), *[(F.col("id") == true[n]).cast("double").alias(n) if n in true else (F.col("id") % 7).cast("double").alias(n) for n in NUMERIC])
    labels = df.where(" OR ".join(f"{n} = 1" for n in true)).select("sample_key", "event_id")
    best = rank(fit(df, labels, rounds=1), df).orderBy(F.desc("probability")).limit(5).collect()
    assert {r["sample_key"] for r in best[:4]} == {f"s{i}" for i in true.values()} and best[3]["probability"] > best[4]["probability"]


def test_thresholds_are_those_of_all_rows(spark):
    df = spark.range(50_000).select(*[(F.col("id") if n == "number" else F.col("id") % 40 if n == "place" else F.lit(3) if n == "anchor" else (F.col("id") == 49_999)).cast("double").alias(n) for n in NUMERIC])
    n, cuts = thresholds(df)
    told = dict(zip(NUMERIC, cuts, strict=True))
    assert n == 50_000 and told["relevance"] == [0.5] and told["anchor"] == [] and len(told["place"]) == 31
    assert len(told["number"]) == 31 and all(abs(c - 50_000 * i / 32) <= 1 for i, c in enumerate(told["number"], 1))
