import random

import numpy as np

from packloom.llm.subjects import SIZES, fit_accuracies, fit_lexicon, sections, subject_posteriors, subjects, votes, Lexicon

NAMES = {"water": ["水库大坝", "河道淤积", "洪峰过境"], "sport": ["足球联赛", "田径决赛", "主场看台"], "law": ["法院开庭", "原告上诉", "合同条款"]}
FRAME = ["当天关于{}的说明已经送达。", "值班人员记下{}的进展。", "随后又有人问起{}的情况。"]


def story(rng, subject, n):
    return [rng.choice(FRAME).format(rng.choice(NAMES[subject])) for _ in range(n)]


def test_subjects_of_documents(spark):
    rng = random.Random(6)
    examples = [(i, "".join(story(rng, s, 8)), [s]) for i, s in enumerate(list(NAMES) * 25)] + [(900, "空", None), (901, None, ["law"])]
    rows, want = [], set()
    for d in range(300):
        a, b = rng.sample(list(NAMES), 2)
        kind = d % 4
        body = story(rng, a, 10)
        if kind == 1:
            body += story(rng, b, 6)
        elif kind == 2:
            body += story(rng, a, 8) + story(rng, b, 1)
        elif kind == 3:
            body = ["附表3缺页，待补。", "本页为目录。"] * 4
        rng.shuffle(body)
        rows.append((d, "\n".join(["".join(body[i : i + 4]) for i in range(0, len(body), 4)]), f"s{d % 5}", f"{a}域_{d:07d}" if d % 3 else None, "x"))
        want |= {(d, a)} if kind in (0, 2) else {(d, a), (d, b)} if kind == 1 else set()
    rows += [(900, None, None, None, "x"), (901, "  ", None, "water域_1", "x"), (902, "".join(story(rng, "law", 4000)), None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, pack string, subject string")
    areas = spark.createDataFrame([(s, f"{s}域") for s in NAMES], "subject string, name string")
    ex = spark.createDataFrame(examples, "example_id bigint, text string, subjects array<string>")
    got = {tuple(r) for r in subjects(docs, ex, areas).collect()}
    assert len(got ^ (want | {(902, "law")})) <= 2
    assert subject_posteriors(docs.limit(0), ex, areas).count() == 0
    assert subjects(docs, ex.limit(0), areas.limit(0)).count() == 0


def test_latent_model_learns_which_functions_are_right():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.2
    lex = np.where(truth, rng.choice(5, 20_000, p=[0.02, 0.03, 0.05, 0.3, 0.6]), rng.choice(5, 20_000, p=[0.8, 0.1, 0.06, 0.03, 0.01]))
    cols = [lex] + [np.where(rng.random(20_000) < acc, truth, ~truth).astype(int) for acc in (0.9, 0.85, 0.8, 0.5)]
    patterns, inverse, counts = np.unique(np.stack(cols, axis=1), axis=0, return_inverse=True, return_counts=True)
    p, tables, prior = fit_accuracies(patterns, counts.astype(float))
    assert abs(prior - 0.2) < 0.02 and abs(tables[1][1][1] - 0.9) < 0.03 and abs(tables[4][1][1] - 0.5) < 0.05
    assert ((p[inverse.ravel()] >= 0.5) == truth).mean() > 0.95
    assert len(SIZES) == patterns.shape[1]


def test_sections_and_lexicon():
    heading, parts = sections("# 标题\n第一句。第二\n句。\n\n第三句。")
    assert heading == "# 标题" and parts == [["第一句。", "第二句。"], ["第三句。"]]
    assert fit_lexicon([]) == {} and votes(Lexicon({}), "无。", None) == {}
