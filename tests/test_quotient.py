import random

import numpy as np
from pyspark.sql import functions as F

from packloom.operators.quotient import QuotientTable, deliveries, identifier, keep_once, permute, surplus, unpermute
from packloom.sources.tables import canonical_digest, canonical_sample_id

SCHEMA = "id bigint, s string, d string, value string, shard int, words string"


def brute(rows):
    seen = {}
    for r in sorted(rows, key=lambda r: r[0]):
        if r[1] is not None and r[2] is not None:
            seen.setdefault((r[1].strip().lower(), r[2].strip().lower().split(":")[-1].strip()), []).append(r[0])
    return sorted(x for ids in seen.values() for x in ids[1:])


def test_permutation_is_a_bijection():
    w = np.arange(30_000, dtype=np.uint64).reshape(-1, 3)
    assert len({tuple(r) for r in permute(w).tolist()}) == len(w)


def test_permutation_can_be_undone():
    for width in (1, 2, 4, 16):
        w = np.random.default_rng(width).integers(0, 2**63, (500, width), dtype=np.uint64)
        assert (unpermute(permute(w)) == w).all()


def test_different_messages_with_one_number(spark):
    rows = [(7, "a", "x"), (7, "b", "y"), (7, "b", "y"), (8, "b", "y"), (9, "long" * 5000, "z"), (10, "long" * 5000, "z"), (11, "a", "x")]
    df = spark.createDataFrame(rows, "id bigint, s string, d string").repartition(3)
    keys = [F.col("s"), F.col("d")]
    assert sorted((r["id"], r["s"][:4]) for r in keep_once(df, keys, "id").collect()) == [(7, "a"), (7, "b"), (9, "long")]
    assert sorted(r[0] for r in surplus(df, keys, "id").collect()) == [7, 8, 10, 11]
    # Short identifiers are not padded for the long one.
    assert {len(r[0]) for r in df.select(identifier(keys)).collect()} == {16, 32768}


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr("packloom.operators.quotient.SHARD_ROWS", 4)
    monkeypatch.setattr("packloom.operators.quotient.FLUSH_AT", 50)
    df = spark.range(4000).selectExpr("id", "cast(id % 700 AS string) AS s")
    got = deliveries(df, [F.col("s")], "id").collect()
    assert len(got) == 4000 and sorted(r["value"] for r in got if not r["surplus"]) == list(range(700))


def test_table_keeps_the_least_and_returns_the_rest():
    rng = random.Random(3)
    keys = [rng.randrange(400) for _ in range(5000)]
    table, out = QuotientTable(1, bits=3), []
    for i in range(0, 5000, 700):
        part = np.array(keys[i : i + 700], dtype=np.uint64)[:, None]
        out += table.insert(permute(part), np.arange(i, i + len(part))).tolist()
    first = {}
    for i, k in enumerate(keys):
        first.setdefault(k, i)
    assert sorted(out) == sorted(set(range(5000)) - set(first.values()))
    assert sorted(table.drain()[1].tolist()) == sorted(first.values())


def test_surplus_with_nulls_spellings_and_a_hot_identity(spark):
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        hot = rng.random() < 0.34
        s = "p_1_Q01" if hot else f"p_{rng.randrange(60)}_Q0{rng.randrange(3)}"
        d = "a" * 64 if hot else f"{rng.randrange(40):064x}"
        s = rng.choice([s, s.lower(), f" {s}", f"{s} "])
        d = rng.choice([d, d.upper(), f"sha256:{d}", f"SHA256:{d}\n"])
        rows.append((i, None if i % 97 == 0 else s, None if i % 53 == 0 else d, "text" * (i % 5), i, None))
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    keys = [canonical_sample_id("s"), canonical_digest("d")]
    assert sorted(r[0] for r in surplus(df, keys, "id").collect()) == brute(rows)
    kept = keep_once(df, keys, "id")
    assert kept.columns == df.columns
    assert kept.count() == len(rows) - len(brute(rows))


def test_names_of_digests(spark):
    d = "0a" * 32
    forms = [d, f"sha256:{d}", f"SHA-256 {d}", f"sha256={d}", f" sha256-{d.upper()} ", f"sha_256: {d}"]
    df = spark.createDataFrame([(f,) for f in forms], "d string")
    assert {r[0] for r in df.select(canonical_digest("d")).collect()} == {d}


def test_ties_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", "x"), (3, "b", "")], "id bigint, s string, d string")
    keys = [canonical_sample_id("s"), canonical_digest("d")]
    assert sorted(r[0] for r in surplus(df, keys, "id").collect()) == [1, 2]
    assert sorted(r["id"] for r in keep_once(df, keys, "id").collect()) == [1, 3]
    assert surplus(df.where(F.lit(False)), keys, "id").count() == 0
