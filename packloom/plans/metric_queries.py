"""Queries of metrics, audits and comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.functions import text as T
from packloom.operators import graph as G
from packloom.operators import metrics as M
from packloom.plans.graph_queries import SCORED
from packloom.plans.sql import base, steps
from packloom.session import cut_lineage
from packloom.sources import relations as R
from packloom.sources.tables import canonical_sample_id, table

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


def _f1(a: str, b: str) -> str:
    x, y = rf"regexp_extract_all(lower({a}), '[\p{{L}}\p{{N}}]')", rf"regexp_extract_all(lower({b}), '[\p{{L}}\p{{N}}]')"
    return f"""(SELECT CASE WHEN len(x) = 0 OR len(y) = 0 THEN (len(x) + len(y) = 0)::INT::DOUBLE ELSE 2.0::DOUBLE * coalesce(list_sum(list_transform(list_intersect(x, y), lambda c: least(len(list_filter(x, lambda z: z = c)), len(list_filter(y, lambda z: z = c))))), 0) / (len(x) + len(y)) END FROM (SELECT {x} AS x, {y} AS y))"""


_SET = "CASE WHEN len({0}) + len({1}) = 0 THEN 1.0 ELSE 2.0::DOUBLE * len(list_intersect({0}, {1})) / (len({0}) + len({1})) END"
_STEP = steps("{0}")
SCORE = f"""
alt1 AS (SELECT p.pred_id, p.sample_key, p.arm, p.chain, unnest(CASE WHEN len(g.chains) > 0 THEN g.chains ELSE [[]::VARCHAR[]] END) AS alt FROM preds1 AS p JOIN gold1 AS g USING (sample_key)),
chain1 AS (SELECT pred_id, max((alt = chain)::INT)::DOUBLE AS exact, max({_SET.format("chain", "alt")})::DOUBLE AS node_f1, max({_SET.format(steps("chain"), steps("alt"))})::DOUBLE AS edge_f1 FROM alt1 GROUP BY pred_id),
answer1 AS (SELECT pred_id, max(f) AS char_f1 FROM (SELECT p.pred_id, {_f1("p.answer", "p.ref")} AS f FROM (SELECT p.pred_id, p.answer, unnest(g.answers) AS ref FROM preds1 AS p JOIN gold1 AS g USING (sample_key)) AS p) GROUP BY pred_id),
fact1 AS (SELECT pred_id, avg(hit) AS coverage FROM (SELECT pred_id, (contains(answer, fact) OR {_f1("answer", "fact")} >= 0.5)::INT AS hit FROM (SELECT p.pred_id, p.answer, unnest(g.required) AS fact FROM preds1 AS p JOIN gold1 AS g USING (sample_key))) GROUP BY pred_id),
bad1 AS (SELECT pred_id, count(*) FILTER (fact <> '' AND contains(answer, fact)) AS forbidden_hits FROM (SELECT p.pred_id, p.answer, unnest(g.forbidden) AS fact FROM preds1 AS p JOIN gold1 AS g USING (sample_key)) GROUP BY pred_id),
score1 AS (SELECT p.pred_id, p.sample_key, p.pack, p.track, p.arm, g.kind, p.confidence, g.level, p.answer, p.chain, coalesce(a.char_f1, 0.0) AS char_f1, c.exact, c.node_f1, c.edge_f1,
  ((p.answer = '无法确定') = (len(list_filter(g.chains, lambda x: len(x) > 0)) = 0))::INT::DOUBLE AS refusal_correct, f.coverage, coalesce(b.forbidden_hits, 0) AS forbidden_hits
  FROM preds1 AS p JOIN gold1 AS g USING (sample_key) JOIN chain1 AS c USING (pred_id) LEFT JOIN answer1 AS a USING (pred_id) LEFT JOIN fact1 AS f USING (pred_id) LEFT JOIN bad1 AS b USING (pred_id))"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each prediction with gold: answer, chain, refusal and fact metrics."""
    p = R.predictions(spark, sf_dir)
    g = R.gold(spark, sf_dir).select("sample_key", "kind", "level", "answers", "chains", "required", "forbidden")
    rows = p.join(g, "sample_key")
    refs = rows.select("pred_id", "answer", F.explode("answers").alias("ref"))
    answer = M.char_f1(refs, "answer", "ref").groupBy("pred_id").agg(F.max("f1").alias("char_f1"))
    facts = M.char_f1(rows.select("pred_id", "answer", F.explode("required").alias("fact")), "answer", "fact")
    coverage = facts.groupBy("pred_id").agg(F.avg((F.contains("answer", "fact") | (F.col("f1") >= 0.5)).cast("int")).alias("coverage"))
    m = M.best_alternative(F.col("chain"), F.col("chains"))
    none = F.size(F.filter("chains", lambda c: F.size(c) > 0)) == 0
    hits = F.size(F.filter("forbidden", lambda f: (f != "") & F.contains(F.col("answer"), f)))
    out = rows.select(
        "pred_id",
        "sample_key",
        "pack",
        "track",
        "arm",
        "kind",
        "confidence",
        "level",
        "answer",
        "chain",
        *[c.alias(n) for n, c in m.items()],
        ((F.col("answer") == M.REFUSAL) == none).cast("double").alias("refusal_correct"),
        hits.cast("bigint").alias("forbidden_hits"),
    )
    return out.join(answer, "pred_id", "left").join(coverage, "pred_id", "left").withColumn("char_f1", F.coalesce("char_f1", F.lit(0.0)))


_VALUES = ["char_f1", "exact", "node_f1", "edge_f1", "refusal_correct", "coverage"]


@query(base("SELECT pred_id, round(char_f1, 4) AS char_f1, round(coverage, 4) AS coverage, forbidden_hits FROM score1", SCORE))
def char_f1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letter F1 with the best reference answer, and facts covered and forbidden, of each prediction."""
    return scores(spark, sf_dir).select("pred_id", F.round("char_f1", 4).alias("char_f1"), F.round("coverage", 4).alias("coverage"), "forbidden_hits")


@query(base("SELECT pred_id, exact, round(node_f1, 4) AS node_f1, round(edge_f1, 4) AS edge_f1, refusal_correct FROM score1", SCORE))
def chain_f1_best_alternative(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain metrics of each prediction against its best whole alternative."""
    return scores(spark, sf_dir).select("pred_id", "exact", F.round("node_f1", 4).alias("node_f1"), F.round("edge_f1", 4).alias("edge_f1"), "refusal_correct")


@query(
    base(
        "SELECT coalesce(arm, '*') AS arm, coalesce(kind, '*') AS kind, count(*) AS samples, "
        + ", ".join(f"round(avg({v}), 4) AS {v}" for v in _VALUES)
        + ", sum(forbidden_hits)::BIGINT AS forbidden_hits, count(*) FILTER (confidence IS NULL) AS refusals FROM score1 GROUP BY GROUPING SETS ((), (arm), (arm, kind))",
        SCORE,
    )
)
def summary_grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of all metrics, in all, by arm and by arm and kind; nulls are left out of a mean."""
    s = scores(spark, sf_dir)
    out = s.groupingSets([[], ["arm"], ["arm", "kind"]], "arm", "kind").agg(
        F.count(F.lit(1)).alias("samples"), *[F.round(F.avg(v), 4).alias(v) for v in _VALUES], F.sum("forbidden_hits").alias("forbidden_hits"), F.count_if(F.col("confidence").isNull()).alias("refusals")
    )
    return out.withColumns({"arm": F.coalesce("arm", F.lit("*")), "kind": F.coalesce("kind", F.lit("*"))})


@query(base("SELECT arm, level, count(*) AS samples, round(avg(confidence), 4) AS confidence FROM score1 WHERE confidence IS NOT NULL AND level IS NOT NULL GROUP BY arm, level", SCORE))
def confidence_by_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean confidence by gold level."""
    s = scores(spark, sf_dir).where("confidence IS NOT NULL AND level IS NOT NULL")
    return s.groupBy("arm", "level").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("confidence"), 4).alias("confidence"))


_FLAG_SQL = "list_filter([CASE WHEN len(chain) = 0 THEN 'empty_chain' END, CASE WHEN len(chain) >= 5 THEN 'long_chain' END, CASE WHEN forbidden_hits > 0 THEN 'forbidden_fact' END, CASE WHEN coverage < 1 THEN 'facts_missing' END, CASE WHEN confidence IS NULL THEN 'no_confidence' END], lambda x: x IS NOT NULL)"


@query(base(f"SELECT flag, arm, count(*) AS rows, round(avg(char_f1), 4) AS char_f1, round(avg(exact), 4) AS exact FROM (SELECT *, unnest({_FLAG_SQL}) AS flag FROM score1) GROUP BY flag, arm", SCORE))
def risk_flag_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by risk flag; a row counts under each of its flags."""
    flags = [("empty_chain", F.size("chain") == 0), ("long_chain", F.size("chain") >= 5), ("forbidden_fact", F.col("forbidden_hits") > 0), ("facts_missing", F.col("coverage") < 1), ("no_confidence", F.col("confidence").isNull())]
    named = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flags]), lambda x: x.isNotNull())
    s = scores(spark, sf_dir).withColumn("flag", F.explode(named))
    return s.groupBy("flag", "arm").agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg("char_f1"), 4).alias("char_f1"), F.round(F.avg("exact"), 4).alias("exact"))


_PROXY = "25 * avg(coverage) + 10 * avg(char_f1) + 25 * avg(node_f1) + 7.5 * avg(edge_f1) + 7.5 * avg(exact)"


@query(base(f"SELECT arm, round(max(CASE WHEN track = 'A' THEN p END) * 0.6 + max(CASE WHEN track = 'B' THEN p END) * 0.3 + max(CASE WHEN track = 'C' THEN p END) * 0.1, 2) AS weighted, round(max(CASE WHEN track = 'A' THEN p END), 2) AS a, round(max(CASE WHEN track = 'B' THEN p END), 2) AS b, round(max(CASE WHEN track = 'C' THEN p END), 2) AS c FROM (SELECT arm, track, {_PROXY} AS p FROM score1 GROUP BY arm, track) GROUP BY arm", SCORE))
def weighted_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted proxy score of each arm; null where a track is missing."""
    a = F.avg
    by_track = scores(spark, sf_dir).groupBy("arm", "track").agg((25 * a("coverage") + 10 * a("char_f1") + 25 * a("node_f1") + 7.5 * a("edge_f1") + 7.5 * a("exact")).alias("p"))
    of = lambda t: F.max(F.when(F.col("track") == t, F.col("p")))
    out = by_track.groupBy("arm").agg(of("A").alias("a"), of("B").alias("b"), of("C").alias("c"))
    return out.select("arm", F.round(F.col("a") * 0.6 + F.col("b") * 0.3 + F.col("c") * 0.1, 2).alias("weighted"), *[F.round(x, 2).alias(x) for x in "abc"])


@query(base("SELECT arm, count(*) FILTER (said AND is_true) AS tp, count(*) FILTER (NOT said AND is_true) AS fn, count(*) FILTER (said AND NOT is_true) AS fp, count(*) FILTER (NOT said AND NOT is_true) AS tn FROM (SELECT p.arm, p.answer = '无法确定' AS said, len(list_filter(g.chains, lambda x: len(x) > 0)) = 0 AS is_true FROM preds1 AS p JOIN gold1 AS g USING (sample_key)) GROUP BY arm"))
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals against samples that have no chain."""
    g = R.gold(spark, sf_dir).select("sample_key", (F.size(F.filter("chains", lambda c: F.size(c) > 0)) == 0).alias("true"))
    rows = R.predictions(spark, sf_dir).join(g, "sample_key").withColumn("said", F.col("answer") == M.REFUSAL)
    said, true = F.col("said"), F.col("true")
    return rows.groupBy("arm").agg(F.count_if(said & true).alias("tp"), F.count_if(~said & true).alias("fn"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & ~true).alias("tn"))


_PAIRED = "paired1 AS (SELECT a.sample_key, a.kind, a.exact AS exact_a, b.exact AS exact_b, a.char_f1 AS f1_a, b.char_f1 AS f1_b FROM score1 AS a JOIN score1 AS b USING (sample_key) WHERE a.arm = 'base' AND b.arm = 'guided')"


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scores(spark, sf_dir)
    arm = lambda name, tag: s.where(F.col("arm") == name).select("sample_key", "kind", F.col("exact").alias(f"exact_{tag}"), F.col("char_f1").alias(f"f1_{tag}"))
    return arm("base", "a").join(arm("guided", "b").drop("kind"), "sample_key")


@query(base("SELECT kind, CASE WHEN exact_a = 0 AND exact_b = 1 THEN 'gain' WHEN exact_a = 1 AND exact_b = 0 THEN 'loss' WHEN exact_a = 1 THEN 'both_hit' ELSE 'both_miss' END AS transition, count(*) AS samples, round(avg(f1_b - f1_a), 4) AS f1_delta FROM paired1 GROUP BY ALL", SCORE + ", " + _PAIRED))
def paired_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gains and losses of exact chains from the one arm to the other, by kind."""
    rows = _paired(spark, sf_dir).withColumn("transition", M.transitions(F.col("exact_a") == 1, F.col("exact_b") == 1))
    return rows.groupBy("kind", "transition").agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg(F.col("f1_b") - F.col("f1_a")), 4).alias("f1_delta"))


@query(
    base(
        """SELECT count(*) AS replicates, round(avg(m), 4) AS mean, round(min(m), 4) AS low, round(max(m), 4) AS high FROM (
        SELECT rep, avg(delta) AS m FROM (SELECT rep, (('0x' || substr(sha256('7:' || rep || ':' || number), 1, 12))::BIGINT) % n AS draw FROM num1, (SELECT count(*) AS n FROM num1), range(50) AS r(rep)) AS d JOIN num1 ON num1.number = d.draw GROUP BY rep)""",
        SCORE
        + ", "
        + _PAIRED
        + ", num1 AS (SELECT sample_key, f1_b - f1_a AS delta, row_number() OVER (ORDER BY ('0x' || substr(md5(sample_key), 1, 2))::INT, sample_key) - 1 AS number FROM paired1)",
    )
)
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, least and greatest of the mean differences of the arms' letter F1 in fifty resamples; the 95 % interval is in ``paired_delta_ci``."""
    rows = cut_lineage(_paired(spark, sf_dir).select("sample_key", (F.col("f1_b") - F.col("f1_a")).alias("delta")))
    means = M.bootstrap_sums(rows, "sample_key", "delta", 50, 7).select((F.col("total") / F.col("n")).alias("m"))
    return means.agg(F.count(F.lit(1)).alias("replicates"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.min("m"), 4).alias("low"), F.round(F.max("m"), 4).alias("high"))


@query(
    """SELECT source, percent, chars AS value FROM (SELECT source, length(text)::INT AS chars, row_number() OVER (PARTITION BY source ORDER BY length(text)) - 1 AS i, count(*) OVER (PARTITION BY source) AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL)
    JOIN (VALUES (0), (50), (90), (95), (99), (100)) AS v(percent) ON i = round_even((n - 1) * percent / 100, 0)"""
)
def nearest_rank_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank quantiles of text lengths by source."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL").select("source", F.length("text").alias("chars"))
    return M.nearest_rank(d, "source", "chars", [0, 50, 90, 95, 99, 100])


@query(
    r"""SELECT 'document' AS what, count(*) AS hashes, sum(n)::BIGINT AS rows, sum(packs)::BIGINT AS pack_places FROM (SELECT md5(lower(regexp_replace(text, '\s+', '', 'g'))) AS h, count(*) AS n, count(DISTINCT pack) AS packs FROM documents WHERE text IS NOT NULL AND pack IS NOT NULL GROUP BY h HAVING count(DISTINCT pack) > 1)
    UNION ALL SELECT 'question', count(*), coalesce(sum(n), 0)::BIGINT, coalesce(sum(packs), 0)::BIGINT FROM (SELECT md5(lower(regexp_replace(question, '\s+', '', 'g'))) AS h, count(*) AS n, count(DISTINCT pack) AS packs FROM questions WHERE question IS NOT NULL AND pack IS NOT NULL GROUP BY h HAVING count(DISTINCT pack) > 1)"""
)
def duplicate_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts and questions that occur in several packs."""

    def count(name: str, column: str) -> DataFrame:
        rows = table(spark, sf_dir, f"{name}s").where(F.col(column).isNotNull() & F.col("pack").isNotNull())
        by = rows.groupBy(F.md5(T.squeezed(F.col(column))).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("pack").alias("packs")).where("packs > 1")
        return by.agg(F.count(F.lit(1)).alias("hashes"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.coalesce(F.sum("packs"), F.lit(0)).alias("pack_places")).select(F.lit(name).alias("what"), "*")

    return count("document", "text").unionByName(count("question", "question"))


_ANOMALY = """SELECT unnest(list_filter([CASE WHEN len(chains) = 0 THEN 'no_chain' END, CASE WHEN len(answers) = 0 THEN 'no_answer' END, CASE WHEN kind = 'unanswerable' AND len(list_filter(chains, lambda x: len(x) > 0)) > 0 THEN 'unanswerable_with_chain' END,
  CASE WHEN len(list_filter(chains, lambda c: len(list_distinct(c)) < len(c))) > 0 THEN 'repeated_node' END, CASE WHEN level IS NULL THEN 'no_level' END, CASE WHEN len(required) = 0 THEN 'no_required_facts' END], lambda x: x IS NOT NULL)) AS anomaly, sample_key FROM gold1"""


@query(base(f"SELECT anomaly, count(*) AS rows, array_to_string(list(sample_key ORDER BY sample_key)[1:10], ',') AS examples FROM ({_ANOMALY}) GROUP BY anomaly"))
def anomaly_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anomalies of gold items, each with the first ten samples."""
    g = R.gold(spark, sf_dir)
    some = F.size(F.filter("chains", lambda c: F.size(c) > 0)) > 0
    rules = [
        ("no_chain", F.size("chains") == 0),
        ("no_answer", F.size("answers") == 0),
        ("unanswerable_with_chain", (F.col("kind") == "unanswerable") & some),
        ("repeated_node", F.exists("chains", lambda c: F.size(F.array_distinct(c)) < F.size(c))),
        ("no_level", F.col("level").isNull()),
        ("no_required_facts", F.size("required") == 0),
    ]
    rows = cut_lineage(g.select("sample_key", F.explode(F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())).alias("anomaly")))
    counts = rows.groupBy("anomaly").agg(F.count(F.lit(1)).alias("rows"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("anomaly").orderBy("sample_key"))).where("n <= 10")
    return counts.join(first.groupBy("anomaly").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sample_key"))), lambda x: x["sample_key"]), ",").alias("examples")), "anomaly")


_BUCKET = "CASE WHEN len(chain) <= 2 THEN len(chain)::VARCHAR ELSE '3+' END"
_RATES = f"""rate1 AS (SELECT track, bucket, count(*) AS n, sum(exact) AS s, (sum(exact) + 2) / (count(*) + 4) AS rate FROM (SELECT track, {_BUCKET} AS bucket, exact FROM score1 WHERE answer <> '无法确定' AND len(chain) > 0) GROUP BY GROUPING SETS ((track), (track, bucket)))"""


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(track, bucket, n, successes, rate)``: smoothed rates of exact chains by track (bucket null) and by track and length."""
    s = scores(spark, sf_dir).where((F.col("answer") != M.REFUSAL) & (F.size("chain") > 0)).select("track", T.length_bucket(F.col("chain")).alias("bucket"), "exact")
    return s.groupingSets([["track"], ["track", "bucket"]], "track", "bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("exact").alias("successes")).withColumn("rate", M.smoothed(F.col("successes"), F.col("n")))


@query(base("SELECT track, coalesce(bucket, '*') AS bucket, n, s AS successes, round(rate, 4) AS rate FROM rate1", SCORE + ", " + _RATES))
def beta_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothed success rates by track and chain length."""
    return rates(spark, sf_dir).select("track", F.coalesce("bucket", F.lit("*")).alias("bucket"), "n", "successes", F.round("rate", 4).alias("rate"))


@query(base(f"SELECT p.pred_id, CASE WHEN p.answer = '无法确定' THEN NULL ELSE round(CASE WHEN b.n >= 20 THEN b.rate ELSE t.rate END, 4) END AS confidence FROM preds1 AS p LEFT JOIN rate1 AS b ON b.track = p.track AND b.bucket = {_BUCKET.replace('chain', 'p.chain')} LEFT JOIN rate1 AS t ON t.track = p.track AND t.bucket IS NULL", SCORE + ", " + _RATES))
def calibrated_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated confidence: the rate of track and length if twenty samples back it, else the track's."""
    r = cut_lineage(rates(spark, sf_dir))
    p = R.predictions(spark, sf_dir).select("pred_id", "track", "answer", T.length_bucket(F.col("chain")).alias("bucket"))
    # At most four rows a track.
    fine = r.where("bucket IS NOT NULL").select("track", "bucket", "n", F.col("rate").alias("fine"))
    coarse = r.where("bucket IS NULL").select("track", F.col("rate").alias("coarse"))
    rows = p.join(fine, ["track", "bucket"], "left").join(coarse, "track", "left")
    return rows.select("pred_id", F.when(F.col("answer") != M.REFUSAL, F.round(F.when(F.col("n") >= 20, F.col("fine")).otherwise(F.col("coarse")), 4)).alias("confidence"))


@query(
    base(
        """SELECT count(*) AS rows, round(avg((x.rate - x.exact) * (x.rate - x.exact)), 4) AS brier FROM (SELECT f.track, f.fold, f.exact, (sum(o.s) + 2) / (sum(o.n) + 4) AS rate FROM fold1 AS f JOIN fsum AS o ON o.track = f.track AND o.fold <> f.fold GROUP BY f.track, f.fold, f.exact, f.pred_id) AS x""",
        SCORE
        + """, fold1 AS (SELECT pred_id, track, exact, ('0x' || substr(sha256(pack), 1, 8))::BIGINT % 5 AS fold FROM score1 WHERE answer <> '无法确定' AND len(chain) > 0),
        fsum AS (SELECT track, fold, sum(exact) AS s, count(*) AS n FROM fold1 GROUP BY ALL)""",
    )
)
def grouped_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brier score of five-fold rates; a pack's samples share a fold."""
    s = scores(spark, sf_dir).where((F.col("answer") != M.REFUSAL) & (F.size("chain") > 0))
    fold = F.conv(F.substring(F.sha2("pack", 256), 1, 8), 16, 10).cast("bigint") % 5
    rows = cut_lineage(s.select("pred_id", "track", "exact", fold.alias("fold")))
    sums = rows.groupBy("track", "fold").agg(F.sum("exact").alias("s"), F.count(F.lit(1)).alias("n"))
    others = sums.select("track", "fold").join(sums.select("track", F.col("fold").alias("o"), "s", "n"), "track").where("o <> fold").groupBy("track", "fold").agg(M.smoothed(F.sum("s"), F.sum("n")).alias("rate"))
    return rows.join(others, ["track", "fold"]).agg(F.count(F.lit(1)).alias("rows"), F.round(F.avg(F.pow(F.col("rate") - F.col("exact"), 2)), 4).alias("brier"))


@query(
    """SELECT arm, coalesce(attempt.finish_reason, '') AS finish_reason, count(*) AS calls, sum(attempt.usage.prompt_tokens)::BIGINT AS prompt_tokens, sum(attempt.usage.completion_tokens)::BIGINT AS completion_tokens,
    round(sum(attempt.usage.prompt_tokens) * 0.27 / 1e6 + sum(attempt.usage.completion_tokens) * 1.1 / 1e6, 4) AS cost, round(sum(attempt.elapsed_seconds), 2) AS seconds FROM attempts GROUP BY ALL"""
)
def cost_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, cost and time of calls by arm and how they ended."""
    a = table(spark, sf_dir, "attempts")
    prompt, completion = F.sum("attempt.usage.prompt_tokens"), F.sum("attempt.usage.completion_tokens")
    return a.groupBy("arm", F.coalesce("attempt.finish_reason", F.lit("")).alias("finish_reason")).agg(
        F.count(F.lit(1)).alias("calls"),
        prompt.alias("prompt_tokens"),
        completion.alias("completion_tokens"),
        F.round(prompt * 0.27 / 1e6 + completion * 1.1 / 1e6, 4).alias("cost"),
        F.round(F.sum("attempt.elapsed_seconds"), 2).alias("seconds"),
    )


@query(
    base(
        """SELECT coalesce(kind, '*') AS kind, count(*) AS samples, count(*) FILTER (hit5) AS hit5, count(*) FILTER (hit10) AS hit10, count(*) FILTER (hit) AS pool FROM (
        SELECT g.sample_key, g.kind, bool_or(n.rnk <= 5) AS hit5, bool_or(n.rnk <= 10) AS hit10, bool_or(n.path IS NOT NULL) AS hit FROM (SELECT sample_key, kind, unnest(list_filter(chains, lambda x: len(x) > 0)) AS c FROM gold1) AS g
        LEFT JOIN (SELECT sample_key, path, row_number() OVER (PARTITION BY sample_key ORDER BY score DESC, array_to_string(path, '>')) AS rnk FROM scored1) AS n ON n.sample_key = g.sample_key AND n.path = g.c GROUP BY g.sample_key, g.kind) GROUP BY GROUPING SETS ((), (kind))""",
        SCORED,
    )
)
def candidate_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose gold chain is among the best five, ten and all scored paths."""
    scored = G.scored_paths(spark, sf_dir)
    ranked = scored.select("sample_key", "path", F.row_number().over(Window.partitionBy("sample_key").orderBy(F.desc("score"), G.joined("path"))).alias("rnk"))
    g = R.gold(spark, sf_dir).select("sample_key", "kind", F.explode(F.filter("chains", lambda c: F.size(c) > 0)).alias("path"))
    hit = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    per = g.join(ranked, ["sample_key", "path"], "left").groupBy("sample_key", "kind").agg(hit(F.col("rnk") <= 5).alias("h5"), hit(F.col("rnk") <= 10).alias("h10"), hit(F.col("rnk").isNotNull()).alias("h"))
    out = per.groupingSets([[], ["kind"]], "kind").agg(F.count(F.lit(1)).alias("samples"), F.count_if("h5").alias("hit5"), F.count_if("h10").alias("hit10"), F.count_if("h").alias("pool"))
    return out.withColumn("kind", F.coalesce("kind", F.lit("*")))


_BACKWARD = "len(list_filter(list_zip({0}[1:len({0})-1], {0}[2:len({0})]), lambda z: try_cast(nullif(regexp_extract(z[2], 'D([0-9]+)', 1), '') AS INT) < try_cast(nullif(regexp_extract(z[1], 'D([0-9]+)', 1), '') AS INT))) > 0"


@query(base(f"SELECT s.split_name, count(*) AS chains, count(*) FILTER ({_BACKWARD.format('c')}) AS reversed FROM (SELECT pack, unnest(chains) AS c FROM gold1) AS g JOIN (SELECT pack, min(lower(trim(split_name))) AS split_name FROM pack_splits WHERE pack IS NOT NULL GROUP BY pack) AS s USING (pack) GROUP BY s.split_name"))
def reversal_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold chains that go back to a smaller id, by split."""
    s = table(spark, sf_dir, "pack_splits").where("pack IS NOT NULL").groupBy("pack").agg(F.min(F.lower(F.trim("split_name"))).alias("split_name"))
    g = R.gold(spark, sf_dir).select("pack", F.explode("chains").alias("c")).join(s, "pack")
    return g.groupBy("split_name").agg(F.count(F.lit(1)).alias("chains"), F.count_if(T.nonmonotonic(F.col("c"))).alias("reversed"))


@query(
    base(
        """SELECT coalesce(reasoning_type, '*') AS reasoning_type, count(*) AS samples, count(*) FILTER (len(ids) = 0) AS no_ids, count(*) FILTER (len(ids) > 0 AND inside) AS ids_inside_chain, count(*) FILTER (covers) AS chain_inside_ids FROM (
        SELECT reasoning_type, ids, len(list_filter(ids, lambda x: NOT list_contains(c, x))) = 0 AS inside, len(list_filter(c, lambda x: NOT list_contains(ids, x))) = 0 AS covers FROM (
          SELECT coalesce(reasoning_type, '') AS reasoning_type, list_distinct(regexp_extract_all(array_to_string(answers, ' '), 'D[0-9]{3,}')) AS ids, chains[1] AS c FROM gold1 WHERE len(chains) > 0 AND len(chains[1]) > 0)) GROUP BY GROUPING SETS ((), (reasoning_type))"""
    )
)
def answer_chain_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the ids in gold answers relate to the first gold chain, in all and by reasoning type."""
    g = R.gold(spark, sf_dir).where((F.size("chains") > 0) & (F.size(F.get("chains", F.lit(0))) > 0))
    g = g.select(F.coalesce("reasoning_type", F.lit("")).alias("reasoning_type"), T.event_ids(F.array_join("answers", " ")).alias("ids"), F.col("chains")[0].alias("c"))
    out = g.groupingSets([[], ["reasoning_type"]], "reasoning_type").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.size("ids") == 0).alias("no_ids"),
        F.count_if((F.size("ids") > 0) & (F.size(F.array_except("ids", "c")) == 0)).alias("ids_inside_chain"),
        F.count_if(F.size(F.array_except("c", "ids")) == 0).alias("chain_inside_ids"),
    )
    return out.withColumn("reasoning_type", F.coalesce("reasoning_type", F.lit("*")))


@query(base("SELECT phrase, count(*) AS questions, count(*) FILTER (list_contains(g.answers, '无法确定') OR list_contains(g.answers, 'undetermined')) AS strict FROM questions1 AS q JOIN gold1 AS g USING (sample_key) JOIN (VALUES ('损失金额'), ('签字人'), ('直接'), ('一步步')) AS v(phrase) ON contains(q.question, phrase) GROUP BY phrase"))
def phrase_gold_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a phrase, and how many of them have a strict refusal as gold."""
    phrases = F.array(*[F.lit(p) for p in ("损失金额", "签字人", "直接", "一步步")])
    q = R.questions(spark, sf_dir).select("sample_key", F.explode(F.filter(phrases, lambda p: F.contains(F.col("question"), p))).alias("phrase"))
    strict = F.array_contains("answers", "无法确定") | F.array_contains("answers", "undetermined")
    return q.join(R.gold(spark, sf_dir).select("sample_key", "answers"), "sample_key").groupBy("phrase").agg(F.count(F.lit(1)).alias("questions"), F.count_if(strict).alias("strict"))


@query(
    base(
        """SELECT outcome, count(*) AS samples, round(avg(gold_rank), 2) AS mean_gold_rank FROM (SELECT sample_key, CASE WHEN chosen THEN 'chosen' WHEN gold_rank IS NULL THEN 'absent' ELSE 'present' END AS outcome, gold_rank FROM (
        SELECT g.sample_key, min(n.rnk) AS gold_rank, coalesce(bool_or(p.pred_id IS NOT NULL), false) AS chosen FROM (SELECT sample_key, unnest(list_filter(chains, lambda x: len(x) > 0)) AS c FROM gold1) AS g
        LEFT JOIN (SELECT sample_key, path, row_number() OVER (PARTITION BY sample_key ORDER BY score DESC, array_to_string(path, '>')) AS rnk FROM scored1) AS n ON n.sample_key = g.sample_key AND n.path = g.c
        LEFT JOIN preds1 AS p ON p.sample_key = g.sample_key AND p.arm = 'guided' AND p.chain = g.c GROUP BY g.sample_key)) GROUP BY outcome""",
        SCORED,
    )
)
def miss_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a gold chain was predicted, else whether it was among the paths at all, with its rank."""
    ranked = G.scored_paths(spark, sf_dir).select("sample_key", "path", F.row_number().over(Window.partitionBy("sample_key").orderBy(F.desc("score"), G.joined("path"))).alias("rnk"))
    g = R.gold(spark, sf_dir).select("sample_key", F.explode(F.filter("chains", lambda c: F.size(c) > 0)).alias("path"))
    p = R.predictions(spark, sf_dir).where("arm = 'guided'").select("sample_key", F.col("chain").alias("path"), F.lit(True).alias("said"))
    per = g.join(ranked, ["sample_key", "path"], "left").join(p, ["sample_key", "path"], "left").groupBy("sample_key").agg(F.min("rnk").alias("gold_rank"), F.coalesce(F.bool_or("said"), F.lit(False)).alias("chosen"))
    outcome = F.when(F.col("chosen"), "chosen").when(F.col("gold_rank").isNull(), "absent").otherwise("present")
    return per.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("gold_rank"), 2).alias("mean_gold_rank"))


@query(
    base(
        """SELECT p.track, p.arm, count(*) AS samples, count(*) FILTER (answer = '无法确定') AS refusals, round(avg(length(answer)), 2) AS mean_chars, round(avg(len(chain)), 2) AS mean_nodes, sum(coalesce(u.n, 0))::BIGINT AS unsupported FROM preds1 AS p
        LEFT JOIN (SELECT pred_id, count(*) FILTER (e.src IS NULL) AS n FROM (SELECT pred_id, pack, chain, unnest(range(1, len(chain))) AS i FROM preds1 WHERE len(chain) > 1) AS s LEFT JOIN pairs1 AS e ON e.pack = s.pack AND e.src = s.chain[s.i] AND e.dst = s.chain[s.i + 1] GROUP BY pred_id) AS u USING (pred_id) GROUP BY p.track, p.arm"""
    )
)
def blind_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refusals, lengths and steps without an edge, by track and arm; no gold is read."""
    p = R.predictions(spark, sf_dir)
    rows = p.where(F.size("chain") > 1).select("pred_id", "pack", F.explode(T.steps(F.col("chain"))).alias("step"))
    known = R.pair_levels(spark, sf_dir).select("pack", F.concat_ws(">", "src", "dst").alias("step"))
    lacking = rows.join(known, ["pack", "step"], "left_anti").groupBy("pred_id").agg(F.count(F.lit(1)).alias("n"))
    return p.join(lacking, "pred_id", "left").groupBy("track", "arm").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("answer") == M.REFUSAL).alias("refusals"),
        F.round(F.avg(F.length("answer")), 2).alias("mean_chars"),
        F.round(F.avg(F.size("chain")), 2).alias("mean_nodes"),
        F.sum(F.coalesce("n", F.lit(0))).alias("unsupported"),
    )


@query(
    base(
        """SELECT coalesce(track, '*') AS track, coalesce(kind, '*') AS kind, count(*) AS samples, count(*) FILTER (x.answer = y.answer) AS same_answer, count(*) FILTER (x.chain = y.chain) AS same_chain, count(*) FILTER (len(y.chain) < len(x.chain)) AS shorter, count(*) FILTER (len(y.chain) > len(x.chain)) AS longer,
        count(*) FILTER ((x.answer = '无法确定') <> (y.answer = '无法确定')) AS refusal_flips FROM (SELECT a.track, q.kind, a.answer AS a1, a.chain AS c1, b.answer AS a2, b.chain AS c2 FROM preds1 AS a JOIN preds1 AS b USING (sample_key) JOIN questions1 AS q USING (sample_key) WHERE a.arm = 'base' AND b.arm = 'guided') AS z,
        LATERAL (SELECT z.a1 AS answer, z.c1 AS chain) AS x, LATERAL (SELECT z.a2 AS answer, z.c2 AS chain) AS y GROUP BY GROUPING SETS ((), (track), (track, kind))"""
    )
)
def output_diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the answers and chains of two arms differ, in all, by track and by track and kind."""
    p = R.predictions(spark, sf_dir)
    a = p.where("arm = 'base'").select("sample_key", "track", F.col("answer").alias("a1"), F.col("chain").alias("c1"))
    b = p.where("arm = 'guided'").select("sample_key", F.col("answer").alias("a2"), F.col("chain").alias("c2"))
    rows = a.join(b, "sample_key").join(R.questions(spark, sf_dir).select("sample_key", "kind"), "sample_key")
    out = rows.groupingSets([[], ["track"], ["track", "kind"]], "track", "kind").agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("a1") == F.col("a2")).alias("same_answer"),
        F.count_if(F.col("c1") == F.col("c2")).alias("same_chain"),
        F.count_if(F.size("c2") < F.size("c1")).alias("shorter"),
        F.count_if(F.size("c2") > F.size("c1")).alias("longer"),
        F.count_if((F.col("a1") == M.REFUSAL) != (F.col("a2") == M.REFUSAL)).alias("refusal_flips"),
    )
    return out.withColumns({"track": F.coalesce("track", F.lit("*")), "kind": F.coalesce("kind", F.lit("*"))})


@query(base("SELECT pred_id, arm, round(node_f1, 4) AS node_f1 FROM score1 ORDER BY node_f1, pred_id LIMIT 30", SCORE))
def worst_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The thirty predictions of the lowest node F1."""
    return scores(spark, sf_dir).orderBy(F.round("node_f1", 4), "pred_id").limit(30).select("pred_id", "arm", F.round("node_f1", 4).alias("node_f1"))


@query(
    base(
        """SELECT sample_key, max(round(100.0 * (instr(t, id) + length(id) - 1) / length(t), 2)) AS end_percent, any_value(length(t)) AS chars FROM (SELECT q.sample_key, d.t, unnest(g.chains[1]) AS id FROM questions1 AS q JOIN gold1 AS g USING (sample_key)
        JOIN (SELECT pack, string_agg(doc_code || chr(10) || text, chr(10) ORDER BY doc_code) AS t FROM docs1 GROUP BY pack) AS d ON d.pack = q.pack WHERE len(g.chains) > 0) WHERE instr(t, id) > 0 GROUP BY sample_key"""
    )
)
def evidence_end_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in a pack's joined text the last piece of the gold chain's evidence ends, in percent."""
    docs = R.documents(spark, sf_dir).select("pack", F.struct("doc_code", "text").alias("d"))
    # A pack's documents form one text; that is what the measure is about.
    whole = docs.groupBy("pack").agg(F.array_join(F.transform(F.array_sort(F.collect_list("d")), lambda d: F.concat(d["doc_code"], F.lit("\n"), d["text"])), "\n").alias("t"))
    g = R.gold(spark, sf_dir).where(F.size("chains") > 0).select("sample_key", F.explode(F.col("chains")[0]).alias("id"))
    rows = R.questions(spark, sf_dir).select("sample_key", "pack").join(g, "sample_key").join(whole, "pack").withColumn("at", F.position("id", "t")).where("at > 0")
    return rows.groupBy("sample_key").agg(F.max(F.round(100.0 * (F.col("at") + F.length("id") - 1) / F.length("t"), 2)).alias("end_percent"), F.any_value(F.length("t")).alias("chars"))


@query(
    """SELECT 'attempts' AS what, count(*) AS rows, count(*) FILTER (attempt.usage.prompt_tokens > 8192) AS over_limit FROM attempts UNION ALL
    SELECT 'documents', count(*), count(*) FILTER (length(text) > 8192) FROM documents UNION ALL SELECT 'refusal_rows', count(*), count(*) FILTER (input_chars > 20000) FROM refusal_rows UNION ALL
    SELECT 'questions', count(*), count(*) FILTER (length(question) > 60) FROM questions"""
)
def precheck_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows over the length limits of each input."""
    parts = [("attempts", "attempt.usage.prompt_tokens > 8192"), ("documents", "length(text) > 8192"), ("refusal_rows", "input_chars > 20000"), ("questions", "length(question) > 60")]
    out = None
    for name, rule in parts:
        one = table(spark, sf_dir, name).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.expr(rule)).alias("over_limit")).select(F.lit(name).alias("what"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    r"""SELECT arm, coalesce(parsed.question_type, '') AS kind, count(*) AS rows, count(DISTINCT lower(regexp_replace(sample_id, '^\s+|\s+$', '', 'g'))) AS samples, round(avg(parsed.confidence), 4) AS confidence FROM attempts WHERE parsed IS NOT NULL GROUP BY ALL"""
)
def attempt_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed attempts by arm and kind."""
    a = table(spark, sf_dir, "attempts").where("parsed IS NOT NULL")
    return a.groupBy("arm", F.coalesce("parsed.question_type", F.lit("")).alias("kind")).agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(canonical_sample_id("sample_id")).alias("samples"), F.round(F.avg("parsed.confidence"), 4).alias("confidence"))


@query(
    base(
        """SELECT kind AS stratum, count(*) AS replicates, round(avg(m), 4) AS mean, round(min(m), 4) AS low, round(max(m), 4) AS high FROM (
        SELECT d.kind, rep, avg(delta) AS m FROM (SELECT kind, rep, (('0x' || substr(sha256('9:' || rep || ':' || number), 1, 12))::BIGINT) % (count(*) OVER (PARTITION BY kind, rep)) AS draw FROM num2, range(30) AS r(rep)) AS d JOIN num2 ON num2.kind = d.kind AND num2.number = d.draw GROUP BY d.kind, rep) GROUP BY kind""",
        SCORE
        + ", "
        + _PAIRED
        + ", num2 AS (SELECT coalesce(kind, '') AS kind, sample_key, f1_b - f1_a AS delta, row_number() OVER (PARTITION BY coalesce(kind, '') ORDER BY ('0x' || substr(md5(sample_key), 1, 2))::INT, sample_key) - 1 AS number FROM paired1)",
    )
)
def bootstrap_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, least and greatest of the mean differences of the arms' letter F1 in thirty resamples inside each kind; the 95 % intervals are in ``paired_delta_ci``."""
    rows = cut_lineage(_paired(spark, sf_dir).select("sample_key", "kind", (F.col("f1_b") - F.col("f1_a")).alias("delta")))
    means = M.bootstrap_sums(rows, "sample_key", "delta", 30, 9, "kind").select("stratum", (F.col("total") / F.col("n")).alias("m"))
    return means.groupBy("stratum").agg(F.count(F.lit(1)).alias("replicates"), F.round(F.avg("m"), 4).alias("mean"), F.round(F.min("m"), 4).alias("low"), F.round(F.max("m"), 4).alias("high"))


@query()
def paired_delta_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean difference of the arms' letter F1 and its 95 % bootstrap interval over 10 000 resamples.

    ``scope`` is ``all`` (resampled as one), ``stratified`` (resampled inside each kind, then taken together) or ``kind``, a row each.
    The bounds are the means at places 0.025 n and 0.975 n, from 0, of the n sorted ones.
    """
    rows = cut_lineage(_paired(spark, sf_dir).select("sample_key", F.coalesce("kind", F.lit("")).alias("kind"), (F.col("f1_b") - F.col("f1_a")).alias("delta")))
    whole = M.bootstrap_means(rows, "sample_key", "delta", 10_000, 7).select(F.lit("all").alias("scope"), F.lit("").alias("kind"), "rep", "n", "total")
    kinds = cut_lineage(M.bootstrap_means(rows, "sample_key", "delta", 10_000, 9, "kind").select(F.lit("kind").alias("scope"), F.col("stratum").alias("kind"), "rep", "n", "total"))
    pooled = kinds.groupBy("rep").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select(F.lit("stratified").alias("scope"), F.lit("").alias("kind"), "rep", "n", "total")
    by = Window.partitionBy("scope", "kind")
    means = whole.unionByName(pooled).unionByName(kinds).select("scope", "kind", "n", (F.col("total") / F.col("n")).alias("m"))
    placed = means.withColumn("place", F.row_number().over(by.orderBy("m")) - 1).withColumn("replicates", F.count(F.lit(1)).over(by))
    at = lambda share: F.round(F.max(F.when(F.col("place") == F.least(F.floor(F.col("replicates") * share), F.col("replicates") - 1), F.col("m"))), 4)
    bounds = placed.groupBy("scope", "kind").agg(F.max("n").alias("samples"), F.max("replicates").alias("replicates"), at(0.025).alias("low"), at(0.975).alias("high"))
    mean = lambda df, scope: df.agg(F.round(F.avg("delta"), 4).alias("mean_delta")).withColumn("scope", F.lit(scope))
    seen = [mean(rows, s).withColumn("kind", F.lit("")) for s in ("all", "stratified")] + [mean(rows.groupBy("kind"), "kind")]
    observed = seen[0].unionByName(seen[1]).unionByName(seen[2])
    return bounds.join(observed, ["scope", "kind"]).select("scope", "kind", "samples", "replicates", "mean_delta", "low", "high")


@query(base("SELECT p.pred_id, (p.answer = '无法确定') = (len(list_filter(g.chains, lambda x: len(x) > 0)) = 0 AND (list_contains(g.answers, '无法确定') OR list_contains(g.answers, 'undetermined'))) AS strict_correct FROM preds1 AS p JOIN gold1 AS g USING (sample_key)"))
def strict_refusal_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a prediction refuses exactly where gold has neither a chain nor another answer than the refusal."""
    none = F.size(F.filter("chains", lambda c: F.size(c) > 0)) == 0
    g = R.gold(spark, sf_dir).select("sample_key", (none & (F.array_contains("answers", "无法确定") | F.array_contains("answers", "undetermined"))).alias("strict"))
    return R.predictions(spark, sf_dir).join(g, "sample_key").select("pred_id", ((F.col("answer") == M.REFUSAL) == F.col("strict")).alias("strict_correct"))


_SET_COSINE = r"coalesce(len(list_intersect({0}, {1})) / nullif(sqrt(len({0}) * len({1})), 0), 0.0)"
_IDEOGRAPHS = r"list_distinct(regexp_extract_all({0}, '[\x{{4e00}}-\x{{9fff}}]'))"


@query(base(f"SELECT pred_id, round(avg((round({_SET_COSINE.format('a', 'b')}, 6) >= 0.7)::INT), 4) AS coverage FROM (SELECT pred_id, {_IDEOGRAPHS.format('answer')} AS a, {_IDEOGRAPHS.format('fact')} AS b FROM (SELECT p.pred_id, p.answer, unnest(g.required) AS fact FROM preds1 AS p JOIN gold1 AS g USING (sample_key))) GROUP BY pred_id"))
def fact_cosine_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of required facts whose cosine with the answer is 0.7 or more; sets of ideographs stand for an encoder's vectors."""
    chars = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"([\x{4e00}-\x{9fff}])"), F.lit(1)))
    g = R.gold(spark, sf_dir).select("sample_key", F.explode("required").alias("fact"))
    rows = R.predictions(spark, sf_dir).join(g, "sample_key").select("pred_id", chars(F.col("answer")).alias("a"), chars(F.col("fact")).alias("b"))
    cosine = F.coalesce(F.size(F.array_intersect("a", "b")) / F.nullif(F.sqrt(F.size("a") * F.size("b")), F.lit(0.0)), F.lit(0.0))
    return rows.groupBy("pred_id").agg(F.round(F.avg((F.round(cosine, 6) >= 0.7).cast("int")), 4).alias("coverage"))
