"""Queries over answers: broken pairs and equal-looking spellings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm.canonical import canonical_text, equal_looking_pairs
from packloom.llm.pairs import broken_pairs
from packloom.sources.tables import canonical_sample_id, table


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = canonical_sample_id("sample_id").alias("sample_key")
    predictions = table(spark, sf_dir, "predictions").select(F.col("pred_id").alias("id"), key, "answer")
    attempts = table(spark, sf_dir, "attempts").select(F.col("delivery_id").alias("id"), key, F.col("parsed.answer").alias("answer"))
    return predictions.unionByName(attempts)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of answers of a sample that look the same but differ."""
    return equal_looking_pairs(_answers(spark, sf_dir), "sample_key", "id", "answer")


def p3_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The canonical form of every answer."""
    return canonical_text(_answers(spark, sf_dir).where("answer IS NOT NULL"), "answer", "canonical")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective rows of attempts, each with one type."""
    key = canonical_sample_id("sample_id").alias("sample_key")
    attempts = table(spark, sf_dir, "attempts").select("delivery_id", key, F.col("parsed.answer").alias("answer"), F.col("attempt.raw").alias("raw"))
    questions = table(spark, sf_dir, "questions").select(key, "question", F.lower(F.trim("question_type")).alias("kind"))
    references = table(spark, sf_dir, "gold").select(F.col("sample_id").alias("key"), F.explode("answers").alias("text"))
    events = table(spark, sf_dir, "case_events")
    names = events.select(F.concat_ws(":", "pack", "event_id").alias("key"), F.explode(F.array("event_type", "trigger_word")).alias("text"))
    return broken_pairs(attempts, questions, references, names)


def p1_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defective rows by type."""
    return p1_found(spark, sf_dir).groupBy("defect_type").agg(F.count(F.lit(1)).alias("rows"))


QUERIES = {"p1_found": p1_found, "p1_census": p1_census, "p3_found": p3_found, "p3_canonical": p3_canonical}

# Fixed values of the SQL, apart from the operator's tables: letters of other scripts, radicals, and what they look like.
_LETTERS = {
    "АВЕЅІЈКМНОРСТХУ": "ABESIJKMHOPCTXY",
    "асеіјорѕхуѵԛԝ": "aceijopsxyvqw",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ": "ABEZHIKMNOPTYX",
    "αικνορυχγ": "aikvopuxy",
    "⼀⼆⼈⼊⼋⼒⼗⼝⼟⼠⼤⼥⼦⼩⼭⼯⼰⼲⼼⼾⼿⽂⽅⽇⽉⽊⽌⽐⽑⽔⽕⽗⽚⽛⽜⽟⽠⽡⽣⽤⽥⽩⽪⽬⽯⽰⽲⽴⽵⽶⽷⽺⽻⽼⾁⾂⾃⾆⾈⾊": "一二人入八力十口土士大女子小山工己干心戶手文方日月木止比毛水火父片牙牛玉瓜瓦生用田白皮目石示禾立竹米糸羊羽老肉臣自舌舟色",
    "⾏⾐⾓⾔⾕⾖⾚⾛⾜⾝⾞⾟⾢⾥⾦⾨⾬⾮⾯⾳⾵⾶⾸⾼⿂⿃⿊⿐": "行衣角言谷豆赤走足身車辛邑里金門雨非面音風飛首高魚鳥黑鼻",
    "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000": " " * 15,
    "‐‑‒−": "----",
    "ⅠⅤⅩⅬⅭⅮⅯⅰⅴⅹⅼⅽⅾⅿ": "IVXLCDMivxlcdm",
}
_FROM, _TO = "".join(_LETTERS), "".join(_LETTERS.values())
_HIDDEN = r"[\x{AD}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{FE00}-\x{FE0F}\x{34F}\x{61C}\x{180B}-\x{180E}]"
_ANSWERS = rf"""
WITH a AS (
  SELECT pred_id AS id, lower(regexp_replace(sample_id, '^\s+|\s+$', '', 'g')) AS sample_key, answer FROM predictions WHERE answer IS NOT NULL
  UNION ALL
  SELECT delivery_id, lower(regexp_replace(sample_id, '^\s+|\s+$', '', 'g')), parsed.answer FROM attempts WHERE parsed.answer IS NOT NULL),
v AS (SELECT *, string_split(regexp_replace(answer, '{_HIDDEN}', '', 'g'), '') AS chars FROM a),
w AS (SELECT *, nfc_normalize(array_to_string(list_transform(chars, lambda x: CASE WHEN x <> '' AND unicode(x) BETWEEN 65281 AND 65374 THEN chr(unicode(x) - 65248) ELSE x END), '')) AS wide FROM v),
l AS (SELECT *, nfc_normalize(translate(wide, '{_FROM}', '{_TO}')) AS letters FROM w),
k AS (SELECT *, string_split(letters, '') AS k FROM l),
c AS (SELECT id, sample_key, answer, array_to_string(list_transform(k, lambda x, i:
        CASE WHEN x IN ('ロ', 'エ', 'カ', '二') AND (coalesce(k[i - 1], '') BETWEEN '㐀' AND '鿿' OR coalesce(k[i + 1], '') BETWEEN '㐀' AND '鿿')
                  AND NOT coalesce(k[i - 1], '') BETWEEN 'ぁ' AND 'ヿ' AND NOT coalesce(k[i + 1], '') BETWEEN 'ぁ' AND 'ヿ'
             THEN translate(x, 'ロエカ', '口工力') ELSE x END), '') AS canonical FROM k)
"""

SQL = {
    "p3_canonical": _ANSWERS + "SELECT id, sample_key, canonical FROM c",
    "p3_found": _ANSWERS
    + r"""SELECT x.id AS id_a, y.id AS id_b FROM c AS x JOIN c AS y
          ON x.sample_key = y.sample_key AND x.canonical = y.canonical AND x.id < y.id AND x.answer <> y.answer
          WHERE regexp_matches(x.canonical, '[^\s]')""",
}
