"""Queries over dense vectors, ranker inputs, staged generation and prompts with candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.functions import text as T
from packloom.operators import generate as G
from packloom.operators import ranker
from packloom.operators import retrieval as V
from packloom.operators.vectors import DIMENSIONS, character_encoder, cosine, encoded, pack_cosines
from packloom.plans.dataset_queries import prompt_json
from packloom.plans.graph_queries import SCORED, path_score_topk
from packloom.plans.sql import base, tokens
from packloom.session import cut_lineage
from packloom.sources import relations as R
from packloom.sources.tables import table

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Share of the lexical score in the fusion, and cosine at which an answer covers a fact.
LEXICAL, COVERED = 0.45, 0.7


def query(sql: str | None = None):
    """Register a function as a query, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _vector(c: str) -> str:
    codes = f"list_transform(string_split({c}, ''), lambda x: unicode(x) % {DIMENSIONS})"
    return f"(SELECT list_transform(range({DIMENSIONS}), lambda d: len(list_filter(u, lambda x: x = d))::DOUBLE) FROM (SELECT CASE WHEN {c} = '' THEN [] ELSE {codes} END AS u))"


def _cos(a: str, b: str) -> str:
    return f"coalesce(list_dot_product({a}, {b}) / nullif(sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})), 0), 0.0)"


@query(
    base(
        f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_key ORDER BY hybrid DESC, ord, event_id) AS rnk FROM (
          SELECT r.sample_key, r.ord, r.event_id, round({LEXICAL}::DOUBLE * r.relevance + {1 - LEXICAL}::DOUBLE * greatest(0.0, round({_cos('a', 'b')}, 6)), 8) AS hybrid
          FROM ranked AS r JOIN (SELECT sample_key, {_vector('question')} AS a FROM questions1) USING (sample_key)
          JOIN (SELECT pack, event_id, {_vector('text')} AS b FROM cand) AS c ON c.pack = r.pack AND c.event_id = r.event_id)) WHERE rnk <= 5"""
    )
)
def hybrid_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates by BM25 and the cosine of encoded texts; the encoder is a parameter of the operator."""
    cosines = pack_cosines(R.questions(spark, sf_dir), R.candidates(spark, sf_dir), character_encoder)
    r = V.ranked_candidates(spark, sf_dir, LEXICAL, cosines.withColumn("cosine", F.round("cosine", 6)))
    return r.where("rnk <= 5").select("sample_key", "ord", "event_id", F.col("relevance").alias("hybrid"), "rnk")


def _against(spark: SparkSession, sf_dir: str, member: str) -> DataFrame:
    """``(pred_id, cosine)`` of each prediction's answer and each text of a member of its gold item."""
    answers = encoded(R.predictions(spark, sf_dir).select("pred_id", "sample_key", "answer"), "answer", character_encoder, "a").drop("answer")
    texts = encoded(R.gold(spark, sf_dir).select("sample_key", F.explode(member).alias("said")), "said", character_encoder, "b").drop("said")
    return answers.join(texts, "sample_key").select("pred_id", F.round(cosine("a", "b"), 6).alias("cosine"))


def _against_sql(member: str) -> str:
    return f"""(SELECT pred_id, round({_cos('a', 'b')}, 6) AS cosine FROM (SELECT p.pred_id, {_vector('p.answer')} AS a, {_vector('g.said')} AS b
      FROM preds1 AS p JOIN (SELECT sample_key, unnest({member}) AS said FROM gold1) AS g USING (sample_key)))"""


@query(base(f"SELECT pred_id, max(cosine) AS cosine FROM {_against_sql('answers')} GROUP BY pred_id"))
def answer_vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greatest cosine of a prediction's answer with the reference answers of its sample."""
    return _against(spark, sf_dir, "answers").groupBy("pred_id").agg(F.max("cosine").alias("cosine"))


@query(base(f"SELECT pred_id, round(avg((cosine >= {COVERED})::INT), 4) AS coverage FROM {_against_sql('required')} GROUP BY pred_id"))
def fact_vector_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the required facts whose vector's cosine with the answer's is COVERED or more."""
    return _against(spark, sf_dir, "required").groupBy("pred_id").agg(F.round(F.avg((F.col("cosine") >= COVERED).cast("int")), 4).alias("coverage"))


@query()
def normalized_doc_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document's text in its compatibility form, without white space, in one case."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(T.normalized("text"), 256).alias("digest"))


@query(
    base(
        f"""SELECT sample_key, event_id, relevance, round((rnk - 1) / greatest(1, n - 1), 6) AS place, list_contains(ids, event_id)::INT AS anchor,
        round(len(list_intersect(qt, lt)) / greatest(1, len(lt)), 6) AS label_overlap, round(len(list_intersect(qt, xt)) / greatest(1, len(qt)), 6) AS text_overlap,
        round(coalesce(try_cast(nullif(regexp_extract(event_id, '[0-9]+'), '') AS DOUBLE), nth) / greatest(1, n), 6) AS number, round(least(length(text), 1200) / 1200, 6) AS text_chars,
        round(len(ids) / greatest(1, n), 6) AS named_share, round(least(length(question), 500) / 500, 6) AS question_chars, visible::INT AS visible,
        CASE WHEN visible THEN round(coalesce(outdegree, 0) / greatest(1, n), 6) ELSE 0.0 END AS outdegree, CASE WHEN visible THEN round(coalesce(indegree, 0) / greatest(1, n), 6) ELSE 0.0 END AS indegree,
        (kind = 'retrospective')::INT AS retrospective, (kind = 'prospective')::INT AS prospective, (kind = 'counterfactual')::INT AS counterfactual, (kind = 'unanswerable')::INT AS unanswerable
        FROM (SELECT r.*, c.text, q.question, q.kind, k.ids, coalesce(q.track NOT IN ('B', 'C'), true) AS visible, count(*) OVER (PARTITION BY r.sample_key) AS n, row_number() OVER (PARTITION BY r.sample_key ORDER BY r.ord, r.event_id) - 1 AS nth,
          list_distinct({tokens('q.question')}) AS qt, list_distinct({tokens('c.label')}) AS lt, list_distinct({tokens('left(c.text, 600)')}) AS xt, o.n AS outdegree, i.n AS indegree
          FROM rank1 AS r JOIN questions1 AS q USING (sample_key) JOIN known1 AS k USING (sample_key) JOIN cand AS c ON c.pack = r.pack AND c.event_id = r.event_id
          LEFT JOIN (SELECT pack, dst, count(*) AS n FROM edges1 GROUP BY ALL) AS i ON i.pack = r.pack AND i.dst = r.event_id
          LEFT JOIN (SELECT pack, src, count(*) AS n FROM edges1 GROUP BY ALL) AS o ON o.pack = r.pack AND o.src = r.event_id)"""
    )
)
def ranker_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sixteen inputs of the learned ranker for each question and candidate, degrees only where the view shows the graph."""
    return ranker.inputs(spark, sf_dir)


@query()
def learned_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best candidates of each question by a ranker fitted on the gold chains of even-numbered packs."""
    features = cut_lineage(ranker.inputs(spark, sf_dir))
    g = R.gold(spark, sf_dir).where(F.crc32("pack") % 2 == 0)
    labels = g.select("sample_key", F.explode(F.flatten("chains")).alias("event_id"))
    model = ranker.fit(features.join(g.select("sample_key"), "sample_key", "left_semi"), labels)
    return ranker.rank(model, features).where("rnk <= 3")


def _drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One draft a question: the guided arm's prediction where there is one, with the ids and edges of its pack."""
    allowed = R.candidates(spark, sf_dir).groupBy("pack").agg(F.collect_set("event_id").alias("allowed"))
    links = R.edges(spark, sf_dir).groupBy("pack").agg(F.transform(F.array_sort(F.collect_set(F.struct("pos", "src", "dst"))), lambda x: F.array(x["src"], x["dst"])).alias("links"))
    p = R.predictions(spark, sf_dir).where("arm = 'guided'").select("sample_key", "answer", "chain", "confidence")
    q = R.questions(spark, sf_dir).select("sample_key", "pack", F.col("question").alias("prompt"))
    return q.join(allowed, "pack", "left").join(links, "pack", "left").join(p, "sample_key", "left")


@query()
def route_and_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of the two-stage generation over every question's draft, by stand-in models."""
    r = G.routed(_drafts(spark, sf_dir), G.mock_router, G.mock_model)
    return r.select("sample_key", "decision", "route", F.size("candidates").alias("candidates"), "answer", F.array_join("evidence_chain", ">").alias("chain"))


@query()
def locked_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drafts written anew for the chain they have, by a stand-in model."""
    r = G.rewritten(_drafts(spark, sf_dir).where("answer IS NOT NULL"), G.mock_model)
    return r.select("sample_key", "outcome", "answer", F.array_join("evidence_chain", ">").alias("chain"))


@query(base("SELECT sample_key, string_agg('候选 ' || rnk || '：' || replace(path, '>', ' → '), chr(10) ORDER BY rnk) AS options FROM (SELECT sample_key, array_to_string(path, '>') AS path, row_number() OVER (PARTITION BY sample_key ORDER BY score DESC, array_to_string(path, '>')) AS rnk FROM scored1) WHERE rnk <= 5 GROUP BY sample_key", SCORED))
def numbered_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered list of candidate paths that goes before a question's material."""
    lines = F.collect_list(F.struct("rnk", F.concat(F.lit("候选 "), F.col("rnk").cast("string"), F.lit("："), F.replace("path", F.lit(">"), F.lit(" → "))).alias("line")))
    return path_score_topk(spark, sf_dir).groupBy("sample_key").agg(F.array_join(F.transform(F.array_sort(lines), lambda x: x["line"]), "\n").alias("options"))


@query()
def guided_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evidence index of each question, as JSON, before its whole material."""
    h = V.hints(spark, sf_dir).groupBy("sample_key").agg(F.array_sort(F.collect_list(F.struct("place", "event_id", "source"))).alias("candidate_evidence"))
    p = prompt_json(spark, sf_dir).join(h, "sample_key", "left")
    return p.select("sample_key", F.concat_ws("\n\n", F.to_json(F.struct("candidate_evidence")), "prompt").alias("prompt"))
