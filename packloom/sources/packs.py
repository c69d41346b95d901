"""Readers of pack folders, JSON and JSON lines with explicit schemas, and of polymorphic gold files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.operators import contract as C

# File names and members of a pack folder.
EVENTS_FILE, EDGES_FILE, QUESTIONS_FILE, GOLD_FILE = "事件列表.json", "事件因果关系列表.json", "问题.json", "问答对_答案.json"
EDGE = "cause_event_id string, result_event_id string, effect_event_id string, causal_type string, relation_type string, confidence_level string"
QUESTION = "sample_id string, question_type string, question string, reasoning_type string"


def track_of(path: Column) -> Column:
    """Track from a path: a folder named A, B, C or train (in any case), or one that begins so before an underscore."""
    found = F.regexp_extract(path, r"(?i)/(?:track[_-]?)?([ABC]|train)(?:[_-][^/]*)?/", 1)
    return F.when(F.lower(found) == "train", "train").when(found != "", F.upper(found))


def _located(df: DataFrame) -> DataFrame:
    path = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    return df.select("*", path.alias("path")).withColumn("track", track_of(F.col("path")))


def _whole(spark: SparkSession, root: str, glob: str) -> DataFrame:
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root, wholetext=True)
    return _located(df)


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """``(pack, track, doc_code, text)`` of the files D<digits>*.txt below ``root``; the file's stem is the code."""
    d = _whole(spark, root, "D[0-9]*.txt")
    return d.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("pack"), "track", F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("doc_code"), F.col("value").alias("text"))


def _elements(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Elements of JSON files that hold an array, in order, as VARIANT; a file that is none gives a row with a null element."""
    files = _whole(spark, root, name)
    value = F.try_parse_json(F.col("value"))
    listed = F.when(C.kind(value) == "LIST", F.try_variant_get(value, "$", "array<variant>"))
    return files.select(F.regexp_replace("path", r"/[^/]+$", "").alias("folder"), "track", F.posexplode_outer(listed).alias("pos", "item"))


def read_events(spark: SparkSession, root: str) -> DataFrame:
    """``(pack, track, pos, event_id, doc_id, event_type, trigger_word, occur_time, argument)``; an argument that is no object comes under the empty name."""
    e = _elements(spark, root, EVENTS_FILE).where("item IS NOT NULL")
    text = lambda n: F.try_variant_get("item", f"$.{n}", "string").alias(n)
    argument = F.try_variant_get("item", "$.argument", "variant")
    as_map = F.when(C.kind(argument) == "OBJECT", F.try_variant_get("item", "$.argument", "map<string,string>")).when(C.kind(argument) != "NULL", F.create_map(F.lit(""), F.try_variant_get("item", "$.argument", "string")))
    return e.select(F.regexp_extract("folder", r"([^/]+)$", 1).alias("pack"), "track", "pos", text("event_id"), text("doc_id"), text("event_type"), text("trigger_word"), text("occur_time"), as_map.alias("argument"))


def _typed(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    e = _elements(spark, root, name).where("item IS NOT NULL")
    columns = [c.strip().split()[0] for c in schema.split(",")]
    return e.select(F.regexp_extract("folder", r"([^/]+)$", 1).alias("pack"), "track", "pos", *[F.try_variant_get("item", f"$.{c}", "string").alias(c) for c in columns])


def read_edges(spark: SparkSession, root: str) -> DataFrame:
    """``(pack, track, pos, cause_event_id, ...)`` in file order."""
    return _typed(spark, root, EDGES_FILE, EDGE)


def read_questions(spark: SparkSession, root: str, track: str | None = None) -> DataFrame:
    """``(pack, track, pos, sample_id, question_type, question, reasoning_type)``; a track is filtered by path before files are parsed."""
    q = _typed(spark, root, QUESTIONS_FILE, QUESTION)
    return q if track is None else q.where(F.col("track") == track)


def question_violations(questions: DataFrame) -> DataFrame:
    """``(pack, pos, sample_id, violation)``: blank members and ids that occur twice, instead of an exception."""
    blank = F.exists(F.array("sample_id", "question_type", "question"), lambda x: F.coalesce(F.trim(x), F.lit("")) == "")
    twice = questions.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 AND sample_id IS NOT NULL").select("sample_id")
    a = questions.where(blank).select("pack", "pos", "sample_id", F.lit("blank").alias("violation"))
    return a.unionByName(questions.join(twice, "sample_id", "left_semi").select("pack", "pos", "sample_id", F.lit("repeated").alias("violation")))


def read_gold(spark: SparkSession, root: str) -> DataFrame:
    """Gold items with their polymorphic members normalised to arrays of texts."""
    g = _elements(spark, root, GOLD_FILE).where("item IS NOT NULL")
    at = lambda p: F.try_variant_get("item", p, "variant")
    pack = F.regexp_extract(F.regexp_replace("folder", "/gold$", ""), r"([^/]+)$", 1)
    answers = F.when(C.kind(at("$.answers")) != "NULL", C.text_or_list(at("$.answers"))).otherwise(C.text_or_list(at("$.answer")))
    return g.select(
        pack.alias("pack"),
        "pos",
        F.try_variant_get("item", "$.sample_id", "string").alias("sample_id"),
        answers.alias("answers"),
        F.coalesce(F.try_variant_get("item", "$.evidence_chains", "array<array<string>>"), F.array().cast("array<array<string>>")).alias("evidence_chains"),
        C.facts(at("$.answer_facts.required_facts")).alias("required_facts"),
        C.facts(at("$.answer_facts.forbidden_facts")).alias("forbidden_facts"),
        F.try_variant_get("item", "$.confidence_level", "string").alias("confidence_level"),
        F.try_variant_get("item", "$.annotations.causal_path", "array<string>").alias("causal_path"),
    )


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a given schema; broken lines come out whole in ``_corrupt``."""
    return spark.read.schema(f"{schema}, _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path)


def view(documents: DataFrame, events: DataFrame, edges: DataFrame, name: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The parts of packs that a view may see: A everything, B no edges, C documents only."""
    none = F.lit(False)
    return documents, events.where(none) if name == "C" else events, edges.where(none) if name in ("B", "C") else edges
