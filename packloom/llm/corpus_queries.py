"""Queries over the corpus: splits, containers, leaked evaluation texts and subjects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.llm.leakage import leaked
from packloom.llm.packing import pack, token_counts
from packloom.llm.splits import assign_groups, balance, propagate, text_links
from packloom.llm.subjects import CUT, subject_posteriors, subjects
from packloom.session import cut_lineage
from packloom.sources.tables import canonical_sample_id, table

#: Rows of split_targets; a table of more is refused.
MOST_SPLITS = 1000


def _pack_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return propagate(text_links(table(spark, sf_dir, "documents"), "pack", "text"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs tied to other packs by shared texts, with their group's smallest pack."""
    return _pack_labels(spark, sf_dir).select(F.col("record").alias("pack"), F.col("label").alias("group_pack"))


def _shares(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    rows = table(spark, sf_dir, "split_targets").where("share > 0").groupBy("split_name").agg(F.max("share").alias("share")).orderBy("split_name").limit(MOST_SPLITS + 1).collect()
    if len(rows) > MOST_SPLITS:
        raise ValueError(f"more than {MOST_SPLITS} splits")
    return {r["split_name"]: r["share"] for r in rows}


def _pack_types(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All packs, and their labels: the domain, and the types of their questions."""
    questions = table(spark, sf_dir, "questions").dropDuplicates()
    refusals = table(spark, sf_dir, "refusal_rows")
    packs = table(spark, sf_dir, "documents").select("pack").unionByName(questions.select("pack")).unionByName(refusals.select("pack"))
    packs = packs.where("pack IS NOT NULL").distinct()
    domains = packs.select(F.col("pack").alias("record"), F.concat(F.lit("domain:"), F.regexp_replace("pack", "_[^_]*$", "")).alias("label"), F.lit(1).alias("n"))
    kinds = questions.where("pack IS NOT NULL").groupBy(F.col("pack").alias("record"), F.concat(F.lit("type:"), F.coalesce(F.lower(F.trim("question_type")), F.lit(""))).alias("label")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return packs, domains.unionByName(kinds)


def p5_packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pack of documents, questions and refusal_rows with its group and split."""
    packs, labels = _pack_types(spark, sf_dir)
    tied = _pack_labels(spark, sf_dir)
    groups = packs.withColumnRenamed("pack", "record").join(tied, "record", "left").select("record", F.coalesce("label", "record").alias("grp"))
    return assign_groups(groups, labels, _shares(spark, sf_dir)).select(F.col("record").alias("pack"), F.col("grp").alias("group_pack"), "split_name")


def p5_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and label deviation of each split."""
    assigned = cut_lineage(p5_packs(spark, sf_dir).withColumnRenamed("pack", "record"))
    return balance(assigned, _pack_types(spark, sf_dir)[1], _shares(spark, sf_dir))


def p5_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sample of questions and refusal_rows with the split of its pack."""
    key = canonical_sample_id("sample_id").alias("sample_key")
    samples = table(spark, sf_dir, "questions").select("pack", key).unionByName(table(spark, sf_dir, "refusal_rows").select("pack", key)).distinct()
    return samples.join(p5_packs(spark, sf_dir), "pack").select("sample_key", "pack", "split_name")


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bin of every text, or part of a text that exceeds the capacity, for each container size."""
    counts = cut_lineage(token_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))
    containers = table(spark, sf_dir, "container_sizes").withColumnRenamed("capacity_tokens", "capacity")
    return pack(counts, containers).drop("filled", "capacity")


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins, tokens and share of space used for each container size."""
    capacity = table(spark, sf_dir, "container_sizes").select("container", "capacity_tokens")
    used = p6_packed(spark, sf_dir).groupBy("container").agg(F.countDistinct("bin").alias("bins"), F.sum("tokens").alias("tokens"))
    return used.join(F.broadcast(capacity), "container").withColumn("fill", F.round(F.col("tokens") / (F.col("bins") * F.col("capacity_tokens")), 4)).drop("capacity_tokens")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that give away items of eval_items."""
    return leaked(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "text")


def p7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item with the number of documents that give it away."""
    counts = p7_found(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("documents"))
    return table(spark, sf_dir, "eval_items").select("item_id", "kind").join(counts, "item_id", "left").select("item_id", "kind", F.coalesce("documents", F.lit(0)).alias("documents"))


def _subject_inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_examples"), table(spark, sf_dir, "subject_areas")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subjects of documents."""
    return subjects(*_subject_inputs(spark, sf_dir))


def p8_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and expected documents of each subject."""
    p = subject_posteriors(*_subject_inputs(spark, sf_dir))
    counts = p.groupBy("subject").agg(F.count_if(F.col("posterior") >= CUT).alias("documents"), F.round(F.sum("posterior"), 1).alias("expected"))
    return table(spark, sf_dir, "subject_areas").select("subject").join(F.broadcast(counts), "subject", "left").na.fill(0)


QUERIES = {"p5_found": p5_found, "p5_packs": p5_packs, "p5_samples": p5_samples, "p5_balance": p5_balance, "p6_packed": p6_packed, "p6_fill": p6_fill, "p7_found": p7_found, "p7_items": p7_items, "p8_found": p8_found, "p8_composition": p8_composition}
SQL: dict[str, str] = {}
