import random

import numpy as np

from packloom.llm.splits import assign_groups, assign_parcels, normalized, propagate, text_links


def components(rows):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for r, e in rows:
        a, b = find(("r", r)), find(("e", e))
        if a != b:
            parent[a] = b
    groups = {}
    for r, _ in rows:
        groups.setdefault(find(("r", r)), set()).add(r)
    return {r: min(g) for g in groups.values() for r in g}


def test_propagation_on_a_chain_and_random_links(spark):
    rng = random.Random(2)
    rows = [(f"c{i:03d}", bytes([i])) for i in range(60)] + [(f"c{i + 1:03d}", bytes([i])) for i in range(60)]
    rows += [(f"r{rng.randrange(200):03d}", b"x%d" % rng.randrange(150)) for _ in range(260)]
    rows += [(f"h{i:03d}", b"hot") for i in range(150)]
    df = spark.createDataFrame(list(set(rows)), "record string, entity binary")
    assert {r[0]: r[1] for r in propagate(df).collect()} == components(rows)
    assert propagate(df.limit(0)).count() == 0


def test_links_ignore_layout_case_and_width(spark):
    rows = [("p1", "Ab c。"), ("p2", "ａＢ\nc。"), ("p3", "abd。"), (None, "abc。"), ("p4", None), ("p5", "  "), ("p6", " \n"), ("p1", "abc。"), ("p7", "长" * 50_000), ("p8", "长 " * 50_000)]
    got = {r["record"] for r in text_links(spark.createDataFrame(rows, "pack string, text string"), "pack", "text").collect()}
    assert got == {"p1", "p2", "p7", "p8"}
    assert normalized("Ａ b　C") == "abc"


def test_groups_stay_whole_and_shares_hold(spark):
    rng = random.Random(4)
    rows = [(f"r{i:04d}", f"g{i if i % 3 else i // 30:04d}") for i in range(3000)]
    labels = [(r, rng.choice("abc"), 1) for r, _ in rows]
    groups = spark.createDataFrame(rows, "record string, grp string")
    got = assign_groups(groups, spark.createDataFrame(labels, "record string, label string, n int"), {"fit": 0.8, "validation": 0.1, "holdout": 0.1}).collect()
    assert len(got) == 3000
    by_group = {}
    for r in got:
        by_group.setdefault(r["grp"], set()).add(r["split_name"])
    assert all(len(s) == 1 for s in by_group.values())
    for name, share in (("fit", 0.8), ("validation", 0.1), ("holdout", 0.1)):
        own = {r["record"] for r in got if r["split_name"] == name}
        assert abs(len(own) / 3000 - share) < 0.01
        for letter in "abc":
            n = sum(1 for r, x, _ in labels if x == letter)
            assert abs(sum(1 for r, x, _ in labels if x == letter and r in own) / n - share) < 0.02
    empty = groups.limit(0)
    assert assign_groups(empty, spark.createDataFrame([], "record string, label string, n int"), {"fit": 1.0}).count() == 0


def test_parcels_lower_the_deviation():
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 30, (40, 4)).astype(float)
    counts[:, 0] = counts[:, 1:].sum(axis=1)
    split = assign_parcels(counts, np.array([0.5, 0.5]))
    half = counts[split == 0].sum(axis=0) / counts.sum(axis=0)
    assert np.abs(half - 0.5).max() < 0.03
