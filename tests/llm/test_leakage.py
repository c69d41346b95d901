import random

import pytest

from packloom.llm.leakage import Items, leaked, letters, search, width_of

HAN = [chr(0x4E00 + i) for i in range(3000)]


def text(rng, n, words=None):
    return "".join(rng.choice(HAN) for _ in range(n)) if words is None else " ".join(rng.choice(words) for _ in range(n))


def found(spark, docs, items):
    df = spark.createDataFrame(docs, "d bigint, doc_text string").selectExpr("*", "'x' AS item_id").repartition(4)
    return leaked(df, "d", "doc_text", spark.createDataFrame(items, "item_id bigint, text string"), "item_id", "text")


def brute(items, docs, k=12):
    out = set()
    for d, doc in docs:
        t = letters(doc or "")
        for i, item in items:
            s = letters(item or "")
            if 0 < len(s) < k and s in t:
                out.add((d, i))
            run = min(24 if sum("㐀" <= c <= "鿿" for c in s) * 3 >= len(s) else 60, len(s))
            inside = [False] * len(s)
            a = 0
            while a <= len(s) - k:
                b = a
                while b <= len(s) - k and s[b : b + k] in t:
                    b += 1
                if b > a and b - a + k - 1 >= run:
                    inside[a : b + k - 1] = [True] * (b + k - 1 - a)
                a = b + 1
            if len(s) >= k and sum(inside) * 2 >= len(s):
                out.add((d, i))
    return out


@pytest.mark.parametrize("broadcast", [4000, 3])
def test_search_against_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr("packloom.llm.leakage.ITEMS_A_PASS", broadcast)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(800)]
    items = [(i, text(rng, rng.randrange(60, 700))) for i in range(30)] + [(100 + i, text(rng, rng.randrange(60, 160), words)) for i in range(10)]
    docs = []
    for n in range(240):
        i, item = rng.choice(items)
        own = None if i < 100 else words
        kind = n % 6
        if kind == 0:
            part = item
        elif kind == 1:
            part = item[: int(len(item) * 0.6)]
        elif kind == 2:
            part = item[: int(len(item) * 0.35)]
        elif kind == 3:
            cut = len(item) // 3
            part = item[:cut] + text(rng, 5, own) + item[cut : 2 * cut] + text(rng, 5, own) + item[2 * cut :]
        elif kind == 4:
            part = "".join(c + rng.choice(["", "", "\n", " ", "<b>", "**", "​", "，"]) for c in item) if i < 100 else item.upper()
        else:
            part = ""
        docs.append((n, text(rng, rng.randrange(0, 2500), own) + (" " if own else "") + part + (" " if own else "") + text(rng, rng.randrange(0, 2500), own)))
    docs += [(900, None), (901, ""), (902, "短"), (903, "、。 "), (904, items[0][1] * 40)]
    # Also items shorter than a shingle, without letters, and null.
    items += [(998, "ab"), (997, "水。电"), (996, "、 。"), (999, None)]
    docs += [(905, "断水，电力不足"), (906, "断水断电"), (907, "A-B")]
    want = brute(items, docs)
    assert {(905, 997), (907, 998)} <= want
    got = {tuple(r) for r in found(spark, docs, items).collect()}
    assert len(want) > 120
    assert not got - want
    assert len(want & got) >= 0.99 * len(want)


def test_letters():
    assert letters("甲<b>乙</b>&lt;br/&gt;丙&nbsp;Ａ-1 **b**​") == "甲乙丙a1b"


def test_empty_tables_and_widths(spark):
    docs, items = spark.createDataFrame([], "d bigint, t string"), spark.createDataFrame([], "i bigint, t string")
    assert leaked(docs, "d", "t", items, "i", "t").count() == 0
    assert search(Items([]), ["abc" * 30]) == []
    assert [width_of(x) for x in (1, 128, 129, 200, 300, 500, 600)] == [2, 2, 3, 4, 6, 8, 12]


def test_runs_far_apart():
    """Half an item in several long runs, each in another window: at least nine in ten are found."""
    rng = random.Random(4)
    for size, runs, length, gap in ((290, 6, 25, 400), (290, 4, 37, 800), (914, 7, 66, 1000)):
        found = 0
        for _ in range(60):
            item = text(rng, size)
            starts = [round(j * (size - length) / (runs - 1)) for j in range(runs)]
            doc = text(rng, gap) + "".join(item[a : a + length] + text(rng, gap) for a in starts)
            found += len(search(Items([(1, item)]), [doc]))
        assert found >= 54


def test_both_ways_find_the_same(spark, monkeypatch):
    """Thousands of items, a third of the documents a copy of one text, an id that occurs twice."""
    rng = random.Random(12)
    items = [(i, text(rng, rng.randrange(30, 200))) for i in range(5000)]
    docs = [(n, text(rng, 100) + items[n * 7][1] + text(rng, 100) if n % 3 else items[1][1] + items[2][1]) for n in range(300)] + [(5, items[9][1])]
    many = sorted(map(tuple, found(spark, docs, items).collect()))
    monkeypatch.setattr("packloom.llm.leakage.ITEMS_A_PASS", 6000)
    assert many == sorted(map(tuple, found(spark, docs, items).collect())) and (5, 9) in many and (3, 2) in many and len(many) >= 400
