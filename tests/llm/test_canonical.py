import random
import re
import unicodedata

from packloom.llm.canonical import KANA, KANA_AS, SAME_SHAPE, canonical_text, equal_looking_pairs

SHAPES = {a: b for line in SAME_SHAPE.strip().splitlines() for b, rest in [line.split(": ", 1)] for a in rest.split()} | dict(zip(KANA, KANA_AS, strict=True))


def shaped(text):
    return "".join(SHAPES.get(c, c) for c in unicodedata.normalize("NFD", text))


def reference(text):
    bare = re.sub("[\u00ad\u200b-\u200f\u2060-\u206f\ufeff\ufe00-\ufe0f]", "", text)
    return unicodedata.normalize("NFC", shaped(unicodedata.normalize("NFKC", shaped(bare))))


def disguise(rng, t):
    out = []
    for c in t:
        kind = rng.randrange(6)
        if kind == 0 and "!" <= c <= "~":
            c = chr(ord(c) + 0xFEE0)
        elif kind == 1:
            c += rng.choice("​⁠﻿­️")
        elif kind == 2 and c == " ":
            c = rng.choice("   　")
        elif kind == 3:
            c = unicodedata.normalize("NFD", c)
        elif kind == 4:
            c = rng.choice([k for k, v in SHAPES.items() if v == c] or [c])
        out.append(c)
    return "".join(out)


def test_disguises_get_one_form_and_match_brute_force(spark):
    rng = random.Random(11)
    base = ["D001(停火)之后,口岸通行受限。", "After D002, the café in São Tomé closed at 7.", "人工智力", "Line one\nline two", "a  b"]
    rows = [(i, rng.choice(["s1", "s2"]), disguise(rng, rng.choice(base)), "x") for i in range(300)]
    rows += [(900, "s1", None, "x"), (901, None, base[0], "x"), (902, "s1", "​ 　", "x"), (903, "s1", " ", "x"), (904, "s1", base[0].lower(), "x"), (905, "s1", "长" * 60_000 + "Ａ", "x"), (906, "s1", "长" * 60_000 + "A", "x")]
    df = spark.createDataFrame(rows, "id bigint, g string, t string, canon string")
    got = {tuple(r) for r in equal_looking_pairs(df, "g", "id", "t").collect()}
    want = set()
    for i, g, t, _ in rows:
        for j, h, u, _ in rows:
            if i < j and g and g == h and t and u and t != u and reference(t).strip() and reference(t) == reference(u):
                want.add((i, j))
    assert got == want and (905, 906) in got
    forms = canonical_text(df.where("t IS NOT NULL").drop("canon"), "t")
    assert set(forms.columns) == {"id", "g", "canon"}
    assert {r["canon"] for r in forms.where("id < 300").collect()} == set(base)
    assert equal_looking_pairs(df.limit(0), "g", "id", "t").count() == 0


def test_visible_differences_stay(spark):
    texts = ["Abc", "abc", "a\nbc", "a bc", "①", "1", "²", "2", "é", "e", "ø", "o", "ł", "l"]
    df = spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "id bigint, g string, t string")
    assert equal_looking_pairs(df, "g", "id", "t").count() == 0


def forms(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    return [r["canon"] for r in canonical_text(df, "t").orderBy("id").collect()]


def test_marks_widths_and_ligatures(spark):
    alike = [["バ", "ハ\u3099", "ﾊﾞ"], ["ガード", "カ\u3099ード", "ｶﾞｰﾄﾞ"], ["fi", "ﬁ"], ["VIII", "Ⅷ"], ["á", "а\u0301", "a\u0301"], ["v\u030f", "ѷ", "ѵ\u030f"], ["한", "\u1112\u1161\u11ab"], ["第一章", "第ー章"], ["加工口岸", "加エロ岸", "加エ口岸"], ["路口,", "路ロ，"]]
    for group in alike:
        assert set(forms(spark, group)) == {group[0]}


def test_kana_words_stay(spark):
    words = ["カード", "漢字カード", "ニ", "ハ", "スーパー", "ロ", "これはカニ", "力", "二"]
    assert forms(spark, words) == words
    assert forms(spark, forms(spark, words + ["ﬁ", "Ⅷ", "ѷ", "加エロ岸"])) == forms(spark, words + ["ﬁ", "Ⅷ", "ѷ", "加エロ岸"])
