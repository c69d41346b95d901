"""Queries of answers built from templates, of report lines and of further samples and groupings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.functions import text as T
from packloom.operators import dataset as D
from packloom.operators import retrieval as V
from packloom.plans.dataset_queries import _GROUPS, splits
from packloom.plans.graph_queries import selected_chain
from packloom.plans.metric_queries import SCORE, scores
from packloom.plans.sql import base
from packloom.session import cut_lineage
from packloom.sources import relations as R
from packloom.sources.tables import table, unbroadcast

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def evidence_texts(spark: SparkSession, sf_dir: str, chains: DataFrame, most: int = 420) -> DataFrame:
    """``(sample_key, evidence)``: the best sentence of each event of ``chains(sample_key, chain)``, in the chain's order.

    Sentences that came before, or that no longer fit the budget of ``most`` characters, are skipped. Chains without any sentence give
    an empty array.
    """
    q = R.questions(spark, sf_dir).select("sample_key", "pack", "question")
    c = R.candidates(spark, sf_dir).select("pack", "event_id", "doc_id", "label")
    docs = R.documents(spark, sf_dir).select("pack", F.col("doc_code").alias("doc_id"), T.evidence_pieces(F.col("text")).alias("parts"))
    docs = docs.withColumn("toks", F.transform("parts", T.tokens))
    nodes = chains.select("sample_key", F.posexplode("chain").alias("place", "event_id")).join(q, "sample_key").join(c, ["pack", "event_id"]).join(docs, ["pack", "doc_id"])
    values = V.sentence_scores(F.array_distinct(T.tokens(F.concat_ws(" ", "question", "label"))), F.col("toks"))
    placed = F.zip_with("parts", values, lambda p, s: F.struct(F.round(s, 6).alias("score"), p.alias("part")))
    best = F.aggregate(placed, F.struct(F.lit(-1.0).alias("score"), F.lit(None).cast("string").alias("part")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a), lambda a: a["part"])
    # A chain has at most twelve events.
    per = nodes.select("sample_key", "place", best.alias("part")).where("part IS NOT NULL").groupBy("sample_key").agg(F.array_sort(F.collect_list(F.struct("place", "part"))).alias("l"))
    kept = V.within_budget(F.transform("l", lambda x: x["part"]), most)
    return unbroadcast(chains.select("sample_key").distinct()).join(per.select("sample_key", kept.alias("evidence")), "sample_key", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))


@query()
def evidence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence for the chain that answers each question."""
    chains = cut_lineage(selected_chain(spark, sf_dir).select("sample_key", F.split("path", ">").alias("chain")))
    return evidence_texts(spark, sf_dir, chains).select("sample_key", F.size("evidence").alias("sentences"), F.array_join("evidence", " ").alias("evidence"))


@query()
def template_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the graph baseline: refusal, evidence of a single event, or the chain's order with its confidence."""
    chains = cut_lineage(selected_chain(spark, sf_dir).select("sample_key", F.split("path", ">").alias("chain")))
    q = R.questions(spark, sf_dir).select("sample_key", "pack", "kind")
    labels = R.candidates(spark, sf_dir).select("pack", "event_id", "label")
    nodes = chains.select("sample_key", F.posexplode("chain").alias("place", "event_id")).join(q, "sample_key").join(labels, ["pack", "event_id"])
    order = nodes.groupBy("sample_key").agg(F.array_sort(F.collect_list(F.struct("place", "event_id", "label"))).alias("l"))
    arrows = F.array_join(F.transform("l", lambda x: F.concat(x["event_id"], F.lit("（"), x["label"], F.lit("）"))), " → ")
    levels = R.pair_levels(spark, sf_dir).select("pack", F.concat_ws(">", "src", "dst").alias("step"), "level")
    steps = chains.join(q, "sample_key").select("sample_key", "pack", F.explode(T.steps(F.col("chain"))).alias("step")).join(levels, ["pack", "step"], "left")
    sure = steps.groupBy("sample_key").agg(F.bool_and(F.coalesce(F.col("level") == "certain", F.lit(False))).alias("certain"), F.bool_and(F.coalesce(F.col("level").isin("certain", "probable"), F.lit(False))).alias("likely"))
    rows = chains.join(q, "sample_key").join(order, "sample_key", "left").join(sure, "sample_key", "left").join(evidence_texts(spark, sf_dir, chains), "sample_key", "left")
    refused = F.col("kind") == "unanswerable"
    single = F.size("chain") == 1
    facts = F.array_join("evidence", " ")
    answer = (
        F.when(refused, "无法确定")
        .when(single, F.coalesce(F.nullif(facts, F.lit("")), F.col("l")[0]["label"]))
        .when(F.col("kind") == "counterfactual", F.concat(F.lit("若起因没有发生，"), arrows, F.lit(" 的传导便失去依据；别的起因无法由材料排除。")))
        .otherwise(F.trim(F.concat(facts, F.lit(" 依给定关系，先后为："), arrows, F.lit("。"))))
    )
    confidence = F.when(refused, None).when(single, 0.5).when(F.col("certain"), 0.9).when(F.col("likely"), 0.7).otherwise(0.5)
    chain = F.when(refused, F.array().cast("array<string>")).otherwise(F.col("chain"))
    return rows.select("sample_key", answer.alias("answer"), F.array_join(chain, ">").alias("chain"), confidence.alias("confidence"))


def table_line(*cells: Column) -> Column:
    """A line of a Markdown table; bars in cells are escaped, null cells empty."""
    escaped = [F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"\|", r"\\|") for c in cells]
    return F.concat(F.lit("| "), F.concat_ws(" | ", *escaped), F.lit(" |"))


@query(base("SELECT arm, track, '| ' || arm || ' | ' || track || ' | ' || count(*) || ' | ' || count(*) FILTER (exact = 1) || ' |' AS line FROM score1 GROUP BY arm, track", SCORE))
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a report's table: exact chains by arm and track."""
    by = scores(spark, sf_dir).groupBy("arm", "track").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("exact") == 1).alias("exact"))
    return by.select("arm", "track", table_line(F.col("arm"), F.col("track"), F.col("n"), F.col("exact")).alias("line"))


@query(
    base(
        "SELECT grp, count(*) AS samples, round(avg(exact), 4) AS exact FROM (SELECT exact, unnest(list_filter(['all', CASE WHEN kind = 'retrospective' THEN 'explicit' END, CASE WHEN kind IN ('prospective', 'counterfactual') THEN 'forward' END, CASE WHEN len(chain) > 2 THEN 'multi_hop' END], lambda x: x IS NOT NULL)) AS grp FROM score1) GROUP BY grp",
        SCORE,
    )
)
def applicability_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact chains by overlapping groups: all, explicit, forward, multi-hop."""
    groups = [F.lit("all"), F.when(F.col("kind") == "retrospective", "explicit"), F.when(F.col("kind").isin("prospective", "counterfactual"), "forward"), F.when(F.size("chain") > 2, "multi_hop")]
    rows = scores(spark, sf_dir).select("exact", F.explode(F.filter(F.array(*groups), lambda x: x.isNotNull())).alias("grp"))
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("exact"), 4).alias("exact"))


@query(base("SELECT arm, round(0.6 * a + 0.3 * b + 0.1 * c, 4) AS recombined, round(total, 4) AS listed, abs(round(0.6 * a + 0.3 * b + 0.1 * c, 4) - round(total, 4)) > 0.01 AS differs FROM (SELECT arm, avg(exact) AS total, avg(exact) FILTER (track = 'A') AS a, avg(exact) FILTER (track = 'B') AS b, avg(exact) FILTER (track = 'C') AS c FROM score1 GROUP BY arm)", SCORE))
def score_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the tracks' scores, weighted, give the listed total."""
    of = lambda t: F.avg(F.when(F.col("track") == t, F.col("exact")))
    by = scores(spark, sf_dir).groupBy("arm").agg(F.avg("exact").alias("total"), of("A").alias("a"), of("B").alias("b"), of("C").alias("c"))
    out = by.select("arm", F.round(0.6 * F.col("a") + 0.3 * F.col("b") + 0.1 * F.col("c"), 4).alias("recombined"), F.round("total", 4).alias("listed"))
    return out.withColumn("differs", F.abs(F.col("recombined") - F.col("listed")) > 0.01)


@query(
    base(
        """SELECT stratum, sample_key FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, sample_key) AS p FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY h, sample_key) AS turn FROM (
        SELECT CASE WHEN len(g1.answers) = 1 AND g1.answers[1] IN ('无法确定', 'undetermined') THEN 'refusal' ELSE 'answer' END AS stratum, s.grp, q.sample_key, md5('13:' || q.sample_key) AS h FROM questions1 AS q JOIN gold1 AS g1 USING (sample_key) JOIN group1 AS s ON s.pack = q.pack)) WHERE turn = 1) WHERE p <= 8""",
        _GROUPS,
    )
)
def isolated_quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight samples of refusals and of answers, no two of packs that share a text."""
    refused = (F.size("answers") == 1) & F.get("answers", F.lit(0)).isin("无法确定", "undetermined")
    g = R.gold(spark, sf_dir).select("sample_key", F.when(refused, "refusal").otherwise("answer").alias("stratum"))
    rows = R.questions(spark, sf_dir).select("sample_key", "pack").join(g, "sample_key").join(splits(spark, sf_dir).select("pack", "grp"), "pack").withColumn("h", F.md5(F.concat(F.lit("13:"), "sample_key")))
    first = rows.withColumn("turn", F.row_number().over(Window.partitionBy("grp").orderBy("h", "sample_key"))).where("turn = 1")
    return first.withColumn("p", F.row_number().over(Window.partitionBy("stratum").orderBy("h", "sample_key"))).where("p <= 8").select("stratum", "sample_key")


@query(base("SELECT kind, domain, sample_key FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY turn, h, sample_key) AS p FROM (SELECT kind, regexp_replace(pack, '_[^_]*$', '') AS domain, sample_key, md5('17:' || kind || ':' || sample_key) AS h, row_number() OVER (PARTITION BY kind, regexp_replace(pack, '_[^_]*$', '') ORDER BY md5('17:' || kind || ':' || sample_key), sample_key) AS turn FROM questions1)) WHERE p <= 6"))
def pilot_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six questions of each kind, of domains not yet seen first."""
    q = R.questions(spark, sf_dir).select("kind", T.domain(F.col("pack")).alias("domain"), "sample_key")
    return D.quota_sample(q, "kind", "domain", "sample_key", 6, 17)


@query(base("SELECT q.track, coalesce(q.kind, '') AS kind, count(*) AS samples, round(avg((r.best <= 3)::INT), 4) AS top3, round(avg((r.best <= 5)::INT), 4) AS top5 FROM questions1 AS q JOIN (SELECT g.sample_key, min(k.rnk) AS best FROM (SELECT DISTINCT sample_key, unnest(flatten(chains)) AS event_id FROM gold1) AS g JOIN rank1 AS k USING (sample_key, event_id) GROUP BY g.sample_key) AS r USING (sample_key) GROUP BY ALL"))
def first_hit_by_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of questions with an event of a gold chain among the top three and five, by track and kind."""
    nodes = R.gold(spark, sf_dir).select("sample_key", F.explode(F.flatten("chains")).alias("event_id")).distinct()
    best = nodes.join(V.ranked_candidates(spark, sf_dir).select("sample_key", "event_id", "rnk"), ["sample_key", "event_id"]).groupBy("sample_key").agg(F.min("rnk").alias("best"))
    rows = R.questions(spark, sf_dir).select("sample_key", "track", F.coalesce("kind", F.lit("")).alias("kind")).join(best, "sample_key")
    hit = lambda k: F.round(F.avg((F.col("best") <= k).cast("int")), 4)
    return rows.groupBy("track", "kind").agg(F.count(F.lit(1)).alias("samples"), hit(3).alias("top3"), hit(5).alias("top5"))


@query("SELECT h AS digest, max(length(text)) AS chars, count(*) AS rows FROM (SELECT sha256(text) AS h, text FROM documents WHERE text IS NOT NULL) GROUP BY h")
def length_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of different texts, keyed by their digest."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.sha2("text", 256).alias("digest"), F.length("text").alias("chars"))
    return d.groupBy("digest").agg(F.max("chars").alias("chars"), F.count(F.lit(1)).alias("rows"))
