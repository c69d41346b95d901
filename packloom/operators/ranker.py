"""A learned re-ranker of candidates: gradient-boosted trees over the ranking features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.functions import text as T
from packloom.operators.retrieval import known_anchors, ranked_candidates
from packloom.sources import relations as R
from packloom.sources.tables import unbroadcast

KINDS = ["retrospective", "prospective", "counterfactual", "unanswerable"]
NUMERIC = ["relevance", "place", "anchor", "label_overlap", "text_overlap", "number", "text_chars", "named_share", "question_chars", "visible", "outdegree", "indegree", *KINDS]
#: Bins of an input in the trees; rows beyond which Spark's trees would tell thresholds by a sample (its square of bins leaves 32 bits), so fitting fails.
BINS, MOST_ROWS = 32, 46_340**2


def inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_key, event_id, *NUMERIC)`` of each question and candidate of its pack, sizes over the pack's number of candidates.

    In the views that hide the graph (tracks B and C) degrees are 0. Tokens of the label, of the text's first 600 characters and of the
    question are compared as sets.
    """
    e = R.edges(spark, sf_dir)
    degree = lambda own, to: e.groupBy("pack", F.col(own).alias("event_id")).agg(F.count(F.lit(1)).alias(to))
    kinds = [F.coalesce((F.col("kind") == k).cast("int"), F.lit(0)).alias(k) for k in KINDS]
    q = R.questions(spark, sf_dir).select("sample_key", "question", "kind", F.coalesce(~F.col("track").isin("B", "C"), F.lit(True)).alias("shown"), F.array_distinct(T.tokens(F.col("question"))).alias("qt"))
    c = R.candidates(spark, sf_dir).select("pack", "event_id", F.length("text").alias("chars"), F.array_distinct(T.tokens(F.col("label"))).alias("lt"), F.array_distinct(T.tokens(F.substring("text", 1, 600))).alias("xt"))
    c = unbroadcast(c.join(degree("src", "out"), ["pack", "event_id"], "left").join(degree("dst", "into"), ["pack", "event_id"], "left"))
    rows = ranked_candidates(spark, sf_dir).join(q, "sample_key").join(known_anchors(spark, sf_dir).drop("pack"), "sample_key").join(c, ["pack", "event_id"])
    own = Window.partitionBy("sample_key")
    rows = rows.withColumn("n", F.count(F.lit(1)).over(own)).withColumn("nth", F.row_number().over(own.orderBy("ord", "event_id")) - 1)
    part = lambda x, whole: F.round(x / F.greatest(F.lit(1), whole), 6)
    seen = lambda x: F.when(F.col("shown"), part(F.coalesce(x, F.lit(0)), F.col("n"))).otherwise(0.0)
    digits = F.nullif(F.regexp_extract("event_id", "([0-9]+)", 1), F.lit("")).try_cast("double")
    return rows.select(
        "sample_key",
        "event_id",
        "relevance",
        part(F.col("rnk") - 1, F.col("n") - 1).alias("place"),
        F.array_contains("ids", F.col("event_id")).cast("int").alias("anchor"),
        part(F.size(F.array_intersect("qt", "lt")), F.size("lt")).alias("label_overlap"),
        part(F.size(F.array_intersect("qt", "xt")), F.size("qt")).alias("text_overlap"),
        part(F.coalesce(digits, F.col("nth")), F.col("n")).alias("number"),
        F.round(F.least("chars", F.lit(1200)) / 1200, 6).alias("text_chars"),
        part(F.size("ids"), F.col("n")).alias("named_share"),
        F.round(F.least(F.length("question"), F.lit(500)) / 500, 6).alias("question_chars"),
        F.col("shown").cast("int").alias("visible"),
        seen(F.col("out")).alias("outdegree"),
        seen(F.col("into")).alias("indegree"),
        *kinds,
    )


def ablated(features: DataFrame, what: str = "none") -> DataFrame:
    """``features`` with nothing told by ids and their order (``id_position``), and by question types too (``id_position_and_type``)."""
    gone = {"none": [], "id_position": ["anchor", "number"], "id_position_and_type": ["anchor", "number", *KINDS]}[what]
    return features.select(*[F.lit(0.0).alias(c) if c in gone else F.col(c) for c in features.columns])


def thresholds(rows: DataFrame) -> tuple[int, list[list[float]]]:
    """Number of ``rows``, and at most BINS - 1 thresholds of each input, by counts of its values over all of them.

    An input of BINS values or fewer has one between any two neighbours; others have bins of about equally many rows.
    """
    told = rows.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in NUMERIC])).alias("at", "value")).groupBy("at", "value").agg(F.count(F.lit(1)).alias("n"))
    own = Window.partitionBy("at")
    told = told.withColumn("middle", F.sum("n").over(own.orderBy("value")) - F.col("n") / 2).withColumn("nth", F.row_number().over(own.orderBy("value")))
    told = told.withColumn("total", F.sum("n").over(own)).withColumn("values", F.count(F.lit(1)).over(own))
    piece = F.when(F.col("values") <= BINS, F.col("nth")).otherwise(F.floor(F.col("middle") * BINS / F.col("total")))
    ends = told.groupBy("at", piece.alias("bin")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("n").alias("n")).orderBy("at", "bin").collect()
    by = [[r for r in ends if r["at"] == i] for i in range(len(NUMERIC))]
    return sum(r["n"] for r in by[0]), [sorted({(a["hi"] + b["lo"]) / 2 for a, b in zip(x, x[1:])}) for x in by]


def fit(features: DataFrame, labels: DataFrame, seed: int = 7, rounds: int = 120):
    """A model from ``features(sample_key, event_id, ...)`` and ``labels(sample_key, event_id)`` (the events of gold chains).

    Thresholds and trees come from all rows. Spark's trees would tell thresholds by max(10 000, bins squared) rows, so they get the inputs'
    bins, with room for so many that all rows are read; a tree's counts have only the bins that there are.
    """
    from pyspark.ml import PipelineModel
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import Bucketizer, VectorAssembler

    n, cuts = thresholds(features)
    if n > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} rows to fit a ranker from")
    rows = features.join(labels.select("sample_key", "event_id").distinct().withColumn("label", F.lit(1.0)), ["sample_key", "event_id"], "left").na.fill(0.0, ["label"])
    binned = [f"{c}_bin" for c in NUMERIC]
    bins = Bucketizer(splitsArray=[[-math.inf, *(c or [0.0]), math.inf] for c in cuts], inputCols=NUMERIC, outputCols=binned)
    vectors = VectorAssembler(inputCols=binned, outputCol="features")
    trees = GBTClassifier(maxIter=rounds, maxDepth=4, stepSize=0.07, seed=seed, maxBins=max(BINS, math.isqrt(max(n, 1) - 1) + 1))
    return PipelineModel([bins, vectors, trees.fit(vectors.transform(bins.transform(rows)).select("features", "label"))])


def rank(model, features: DataFrame) -> DataFrame:
    """``(sample_key, event_id, probability, rnk)`` by falling probability; ties keep the lexical place."""
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(features)
    out = scored.select("sample_key", "event_id", "place", F.round(vector_to_array("probability")[1], 6).alias("probability"))
    return out.withColumn("rnk", F.row_number().over(Window.partitionBy("sample_key").orderBy(F.desc("probability"), "place"))).drop("place")
