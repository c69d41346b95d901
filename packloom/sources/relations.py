"""The project's relations after cleaning: one row for each document, event, edge, question, gold item and prediction.

Each function reads one table of a folder. Rows with a null key are left out; of repeated keys one row stays, the first
by the order named. All grow with the corpus, so no join broadcasts them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.sources.tables import canonical_sample_id, table, unbroadcast


def first_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pack, doc_code, text)``, the lowest doc_id with a text."""
    d = unbroadcast(table(spark, sf_dir, "documents")).where("pack IS NOT NULL AND doc_code IS NOT NULL AND text IS NOT NULL")
    return d.groupBy("pack", "doc_code").agg(F.min_by("text", "doc_id").alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pack, pos, event_id, doc_id, event_type, trigger_word, argument)``; the document defaults to the event's id."""
    e = unbroadcast(table(spark, sf_dir, "case_events")).where("pack IS NOT NULL AND event_id IS NOT NULL")
    e = e.select("pack", "pos", "event_id", F.coalesce("doc_id", "event_id").alias("doc_id"), "event_type", "trigger_word", "argument")
    return first_by(e, ["pack", "event_id"], [F.col("pos"), F.coalesce("event_type", F.lit("")), F.coalesce("trigger_word", F.lit(""))])


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pack, pos, src, dst, causal_type, level)`` with the older member names folded in; levels in lower case."""
    return unbroadcast(table(spark, sf_dir, "edges")).select(
        "pack",
        "pos",
        F.col("cause_event_id").alias("src"),
        F.coalesce("result_event_id", "effect_event_id").alias("dst"),
        F.coalesce("causal_type", "relation_type").alias("causal_type"),
        F.lower(F.trim("confidence_level")).alias("level"),
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw edges between known events, without loops; double edges stay, in file order."""
    known = events(spark, sf_dir).select("pack", "event_id")
    valid = raw_edges(spark, sf_dir).where("src <> dst")
    valid = valid.join(known.withColumnRenamed("event_id", "src"), ["pack", "src"], "left_semi")
    return unbroadcast(valid.join(known.withColumnRenamed("event_id", "dst"), ["pack", "dst"], "left_semi")).select("pack", "pos", "src", "dst", "causal_type", "level")


def pair_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pack, src, dst, level, causal_type)``: the attributes of the last of double edges."""
    e = edges(spark, sf_dir)
    return e.groupBy("pack", "src", "dst").agg(F.max(F.struct("pos", "level", "causal_type")).alias("x")).select("pack", "src", "dst", "x.level", "x.causal_type")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_key, pack, track, pos, kind, question, reasoning_type)``; ``kind`` is the question type in one spelling."""
    q = unbroadcast(table(spark, sf_dir, "questions")).select(
        canonical_sample_id("sample_id").alias("sample_key"), "pack", "track", "pos", F.lower(F.trim("question_type")).alias("kind"), "question", "reasoning_type"
    )
    return first_by(q.where("sample_key IS NOT NULL AND question IS NOT NULL"), ["sample_key"], [F.col("pack"), F.col("pos"), F.col("question")])


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_key, pack, kind, reasoning_type, answers, chains, required, forbidden, level, causal_path)``; null arrays are empty."""
    g = unbroadcast(table(spark, sf_dir, "gold"))
    empty = lambda c: F.coalesce(c, F.array())
    g = g.select(
        canonical_sample_id("sample_id").alias("sample_key"),
        "pack",
        F.lower(F.trim("question_type")).alias("kind"),
        "reasoning_type",
        F.filter(empty("answers"), lambda x: x.isNotNull()).alias("answers"),
        F.filter(empty("evidence_chains"), lambda x: x.isNotNull()).alias("chains"),
        F.filter(empty("required_facts"), lambda x: x.isNotNull()).alias("required"),
        F.filter(empty("forbidden_facts"), lambda x: x.isNotNull()).alias("forbidden"),
        F.lower(F.trim("confidence_level")).alias("level"),
        "causal_path",
    )
    return first_by(g.where("sample_key IS NOT NULL"), ["sample_key"], [F.col("pack")])


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pred_id, sample_key, pack, track, arm, answer, chain, confidence)``: the lowest pred_id with an answer of each sample and arm."""
    p = unbroadcast(table(spark, sf_dir, "predictions")).where("answer IS NOT NULL")
    p = p.select("pred_id", canonical_sample_id("sample_id").alias("sample_key"), "pack", "track", "arm", "answer", F.filter(F.coalesce("evidence_chain", F.array()), lambda x: x.isNotNull()).alias("chain"), "confidence")
    return first_by(p.where("sample_key IS NOT NULL AND arm IS NOT NULL"), ["sample_key", "arm"], [F.col("pred_id")])


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranking candidates ``(pack, ord, event_id, doc_id, label, text)``.

    A pack with events has one for each event: id, label, trigger, at most 450 characters of its arguments and of its
    document. Other packs have one for each document: its first line as label and 900 characters of text.
    """
    docs, ev = documents(spark, sf_dir), events(spark, sf_dir)
    label = F.coalesce(F.nullif("event_type", F.lit("")), F.nullif("trigger_word", F.lit("")), "event_id")
    arguments = F.coalesce(F.array_join(F.map_values("argument"), "；"), F.lit(""))
    with_docs = ev.join(docs.withColumnRenamed("doc_code", "doc_id"), ["pack", "doc_id"], "left")
    of_events = with_docs.select(
        "pack",
        F.col("pos").alias("ord"),
        "event_id",
        "doc_id",
        label.alias("label"),
        F.concat_ws(" ", "event_id", label, F.coalesce("trigger_word", F.lit("")), F.substring(arguments, 1, 450), F.substring(F.coalesce("text", F.lit("")), 1, 450)).alias("text"),
    )
    alone = docs.join(ev.select("pack").distinct(), "pack", "left_anti")
    lines = F.filter(F.split("text", "\n"), lambda s: F.trim(s) != "")
    title = F.when(F.size(lines) > 0, F.substring(F.regexp_replace(lines[0], "^[ #：:。\t]+|[ #：:。\t]+$", ""), 1, 60)).otherwise(F.col("doc_code"))
    order = F.row_number().over(Window.partitionBy("pack").orderBy("doc_code")) - 1
    of_docs = alone.select("pack", order.alias("ord"), F.col("doc_code").alias("event_id"), F.col("doc_code").alias("doc_id"), title.alias("label"), F.substring("text", 1, 900).alias("text"))
    return unbroadcast(of_events.unionByName(of_docs))
