import pytest

from packloom.llm.pairs import Endings, broken_pairs, carried, copies, defect, language, refuses

REFS = [f"D{i:03d}（停电）的直接起因是D{i + 1:03d}（暴雨）：设备老化，造成供水中断。记录显示出口放缓。" for i in range(60)] + [f"The record D{i:03d} notes that power failed, which led to D00{i % 9}." for i in range(60)]
ENDS = Endings.fit(REFS, ["停电", "暴雨", "供水中断"] * 20)
Q = "D001（停电）之后，霁汀原州紧接着面临什么？"
E = "What followed from D001 (power cut) in Upper Tavora?"


@pytest.mark.parametrize(
    ("question", "answer", "kind", "want"),
    [
        (Q, None, "", "empty"),
        (Q, " ​—— 。", "", "empty"),
        (Q, Q, "", "copies_question"),
        (Q, "题目：" + Q + "\n答：", "", "copies_question"),
        (Q, "您问的是：" + Q, "", "copies_question"),
        (Q, Q + Q, "", "copies_question"),
        (E, E.upper(), "", "copies_question"),
        (E, "The question is: " + E[:-1] + "\nAnswer:", "", "copies_question"),
        (Q, f"关于“{Q}”，回答如下：D001（停电）的直接起因是D002（暴雨）：设备老化，造成供水中断。", "", None),
        (Q, "无法确定", "", "refusal"),
        (Q, "无​法确定。建议补充材料后再问。", "prospective", "refusal"),
        (Q, "无法确定", "unanswerable", None),
        (Q, "无法确定具体数额，但D002（暴雨）直接引发D003（停电），链条清楚。", "", None),
        (E, "As an assistant I must decline to judge this.", "", "refusal"),
        (E, "The exact toll cannot be determined, but D002 (storm) directly caused D003 (outage).", "", None),
        (Q, "D001（停电）的直接起因是D0", "", "truncated"),
        (Q, "D001（停电）的直接起因是D002（", "", "truncated"),
        (Q, "D001（停电）的直接起因是D002（暴雨）：设备老化，造成", "", "truncated"),
        (Q, "栾汀埠区先有签署协定，由于备忘录超出设计上限，才致使，", "unanswerable", "truncated"),
        (Q, "该题超出可判断范围", "", "refusal"),
        (Q, "霁汀原州停电", "", None),
        (Q, "直接起因为D002（暴雨）", "", None),
        (E, "The record D001 notes that power failed, which", "", "truncated"),
        (Q, "The record D001 notes that power failed, which led to D002.", "", "other_language"),
        (E, "Selon le dossier, D003 découle directement de D001, avec 98 cas signalés.", "", "other_language"),
        (Q, "По материалам, D004 прямо вытекает из D003; отмечено 724 случаев.", "", "other_language"),
        (Q, "資料によると、D007の直接の原因はD005であり、827件の報告がありました。", "", "other_language"),
        (Q, "这一判断与 PM2.5 和 GDP 监测口径一致，D001在先。", "", None),
    ],
)
def test_defects(question, answer, kind, want):
    assert defect(question, kind, answer, False, ENDS) == want


def test_refusal_that_breaks_off():
    assert defect(Q, "unanswerable", "无法确定，因为材料没有", True, ENDS) == "truncated"
    assert defect(Q, "unanswerable", "无法确定", False, ENDS) is None


def test_raw_replies():
    assert carried('<think>x</think>\n{"answer": "甲。", "evidence_chain": []}') == ("甲。", False)
    assert carried('```json\n{"answer": "甲"}\n```') == ("甲", False)
    assert carried('{"answer": "甲乙\\u67') == ("甲乙", True)
    assert carried('{"answer": "甲。", "confid') == ("甲。", False)
    assert carried('{"answer": null}') == (None, False)
    assert carried("") == ("", False)
    assert carried("plain text.") == ("plain text.", False)
    assert carried('{"answ') == (None, False)


def test_dictionaries():
    assert language("D001 GDP 2.5") is None and language("那里的水退了") == "zh" and language("the water fell") == "en"
    assert language("Тhе rесоrd nоtеs thаt рupils lеft") == "en" and language("Событие привело к потере") == "ru"
    assert not refuses("D001之后用户无法登录。") and copies("甲乙丙丁", "甲乙丙丁")


def test_rows(spark):
    rows = [(i, "k", "无法确定" if i % 2 else None, '{"answer": "断' if i % 4 == 0 else None) for i in range(400)] + [(900, None, "无法确定", None), (901, "other", "好。" * 50_000, None)]
    attempts = spark.createDataFrame(rows, "delivery_id bigint, sample_key string, answer string, raw string")
    questions = spark.createDataFrame([("k", Q, "unanswerable"), ("k", Q, "unanswerable"), (None, "x", "y")], "sample_key string, question string, kind string")
    texts = spark.createDataFrame([(str(i), t) for i, t in enumerate(REFS)] + [(None, None)], "key string, text string")
    got = {r[0]: r[1] for r in broken_pairs(attempts, questions, texts, texts).collect()}
    assert got == {i: "truncated" if i % 4 == 0 else "empty" for i in range(0, 400, 2)} | {900: "refusal"}
    assert broken_pairs(attempts.limit(0), questions.limit(0), texts.limit(0), texts.limit(0)).count() == 0


def test_endings_count_every_reference(spark):
    # Of 12 000 references a sample of a third would see the rare ending twice at most, fewer than it needs to count.
    texts = [f"D{i:03d}（停电）的直接起因是D{i + 1:03d}（暴雨）：设备老化，造成供水中断。" for i in range(11_994)] + ["其后桥梁垮塌殆尽"] * 3 + ["记录所载桥梁垮塌殆尽"] * 3
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)] + [(None, None)], "key string, text string").repartition(3)
    every, local = Endings.fit_all(rows, rows.limit(0)), Endings.fit(texts, [])
    assert every.share["尽"] == local.share["尽"] == 1.0
    assert len(every.share) < len(local.share)
    heads = {t[:i] for t in texts[-6:] + texts[:40] for i in range(1, len(t) + 1)}
    assert [every.broken(x) for x in heads] == [local.broken(x) for x in heads]
