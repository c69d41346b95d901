"""Queries of joins, set operations, checks of coverage and lineage, and the idle gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.functions import text as T
from packloom.operators import checks as K
from packloom.plans.sql import base, steps
from packloom.sources import relations as R
from packloom.sources.tables import canonical_sample_id, epoch_micros, table
from packloom.streaming.idle_gate import idle_gate as gate

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


@query(base("SELECT e.pack, e.event_id, e.doc_id, d.text IS NOT NULL AS found, length(coalesce(d.text, '')) AS chars FROM events1 AS e LEFT JOIN docs1 AS d ON d.pack = e.pack AND d.doc_code = e.doc_id"))
def event_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their documents; a missing document counts as the empty text."""
    d = R.documents(spark, sf_dir).withColumnRenamed("doc_code", "doc_id")
    return R.events(spark, sf_dir).join(d, ["pack", "doc_id"], "left").select("pack", "event_id", "doc_id", F.col("text").isNotNull().alias("found"), F.length(F.coalesce("text", F.lit(""))).alias("chars"))


_KEYS = r"lower(regexp_replace(sample_id, '^\s+|\s+$', '', 'g'))"


@query(f"WITH p AS (SELECT {_KEYS} AS sample_key FROM predictions WHERE sample_id IS NOT NULL), g AS (SELECT {_KEYS} AS sample_key FROM gold WHERE sample_id IS NOT NULL) SELECT DISTINCT sample_key, 'unknown' AS violation FROM p WHERE sample_key NOT IN (SELECT sample_key FROM g) UNION ALL SELECT sample_key, 'repeated' FROM p GROUP BY sample_key HAVING count(*) > 1")
def prediction_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions without gold, and samples predicted more than once."""
    key = canonical_sample_id("sample_id").alias("sample_key")
    p, g = (table(spark, sf_dir, t).where("sample_id IS NOT NULL").select(key) for t in ("predictions", "gold"))
    return K.violations(p, g, "sample_key")


@query(base("SELECT coalesce(q.sample_key, p.sample_key) AS sample_key, p.sample_key IS NULL AS missing, q.sample_key IS NULL AS unexpected FROM (SELECT DISTINCT sample_key FROM questions1) AS q FULL JOIN (SELECT DISTINCT sample_key FROM preds1 WHERE arm = 'guided') AS p ON p.sample_key = q.sample_key"))
def coverage_full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions without a guided prediction, and the other way."""
    return K.coverage(R.questions(spark, sf_dir), R.predictions(spark, sf_dir).where("arm = 'guided'"), ["sample_key"])


@query(base("SELECT a.sample_key, round(b.confidence - a.confidence, 4) AS confidence_delta, len(b.chain) - len(a.chain) AS chain_delta FROM preds1 AS a JOIN preds1 AS b USING (sample_key) WHERE a.arm = 'base' AND b.arm = 'guided'"))
def paired_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both arms' predictions of a sample, with their differences."""
    p = R.predictions(spark, sf_dir)
    a = p.where("arm = 'base'").select("sample_key", F.col("confidence").alias("c1"), F.size("chain").alias("n1"))
    b = p.where("arm = 'guided'").select("sample_key", F.col("confidence").alias("c2"), F.size("chain").alias("n2"))
    return a.join(b, "sample_key").select("sample_key", F.round(F.col("c2") - F.col("c1"), 4).alias("confidence_delta"), (F.col("n2") - F.col("n1")).alias("chain_delta"))


@query(base("SELECT q.sample_key, q.pack, q.track, g.kind = q.kind AS kind_agrees, count(p.pred_id) AS predictions, count(t.n) AS attempts FROM questions1 AS q JOIN gold1 AS g USING (sample_key) JOIN preds1 AS p USING (sample_key) LEFT JOIN (SELECT lower(regexp_replace(sample_id, '^\\s+|\\s+$', '', 'g')) AS sample_key, arm, count(*) AS n FROM attempts GROUP BY ALL) AS t ON t.sample_key = q.sample_key AND t.arm = p.arm GROUP BY ALL"))
def experiment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions, gold, predictions and attempts of a sample and arm."""
    t = table(spark, sf_dir, "attempts").groupBy(canonical_sample_id("sample_id").alias("sample_key"), "arm").agg(F.count(F.lit(1)).alias("n"))
    g = R.gold(spark, sf_dir).select("sample_key", F.col("kind").alias("gold_kind"))
    p = R.predictions(spark, sf_dir).select("sample_key", "arm", "pred_id")
    rows = R.questions(spark, sf_dir).join(g, "sample_key").join(p, "sample_key").join(t, ["sample_key", "arm"], "left")
    return rows.groupBy("sample_key", "pack", "track", (F.col("gold_kind") == F.col("kind")).alias("kind_agrees")).agg(F.count("pred_id").alias("predictions"), F.count("n").alias("attempts"))


@query(base("SELECT q.pack, q.sample_key, q.track FROM questions1 AS q SEMI JOIN preds1 AS p ON p.pack = q.pack AND p.sample_key = q.sample_key AND p.track = q.track"))
def composite_key_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a prediction of the same pack, sample and track."""
    keys = ["pack", "sample_key", "track"]
    return R.questions(spark, sf_dir).join(R.predictions(spark, sf_dir).select(*keys), keys, "left_semi").select(*keys)


@query(
    base(
        r"""SELECT q.sample_key FROM questions1 AS q JOIN gold1 AS g USING (sample_key) WHERE coalesce(s(q.pack), '') <> 'fit' AND lower(regexp_replace(q.question, '\s+', '', 'g')) NOT IN (SELECT lower(regexp_replace(f.question, '\s+', '', 'g')) FROM questions1 AS f WHERE coalesce(s(f.pack), '') = 'fit')"""
    ).replace("s(q.pack)", "(SELECT min(lower(trim(split_name))) FROM pack_splits AS z WHERE z.pack = q.pack)").replace("s(f.pack)", "(SELECT min(lower(trim(split_name))) FROM pack_splits AS z WHERE z.pack = f.pack)")
)
def left_anti_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples outside the earlier fit split whose question, layout and case apart, no fit sample has."""
    s = table(spark, sf_dir, "pack_splits").where("pack IS NOT NULL").groupBy("pack").agg(F.min(F.lower(F.trim("split_name"))).alias("split_name"))
    q = R.questions(spark, sf_dir).join(s, "pack", "left").withColumn("template", T.squeezed(F.col("question")))
    seen = q.where("split_name = 'fit'").select("template").distinct()
    rest = q.where("coalesce(split_name, '') <> 'fit'").join(R.gold(spark, sf_dir).select("sample_key"), "sample_key", "left_semi")
    return rest.join(seen, "template", "left_anti").select("sample_key")


@query(base("SELECT q.sample_key, q.pack FROM questions1 AS q SEMI JOIN (SELECT pack FROM pack_splits WHERE lower(trim(split_name)) = 'validation') AS s ON s.pack = q.pack"))
def left_semi_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of packs in the earlier validation split."""
    s = table(spark, sf_dir, "pack_splits").where(F.lower(F.trim("split_name")) == "validation").select("pack")
    return R.questions(spark, sf_dir).join(s, "pack", "left_semi").select("sample_key", "pack")


@query(base("SELECT p.pred_id, p.i, p.chain[p.i] AS src, p.chain[p.i + 1] AS dst, e.src IS NOT NULL AS given, e.level, e.causal_type FROM (SELECT pred_id, pack, chain, unnest(range(1, len(chain))) AS i FROM preds1 WHERE len(chain) > 1) AS p LEFT JOIN pairs1 AS e ON e.pack = p.pack AND e.src = p.chain[p.i] AND e.dst = p.chain[p.i + 1]"))
def step_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The steps of predicted chains with the attributes of the given edge."""
    n = F.size("chain") - 1
    step = F.posexplode(F.zip_with(F.slice("chain", F.lit(1), n), F.slice("chain", F.lit(2), n), lambda a, b: F.struct(a.alias("src"), b.alias("dst"))))
    rows = R.predictions(spark, sf_dir).where(F.size("chain") > 1).select("pred_id", "pack", step.alias("i", "s")).select("pred_id", "pack", (F.col("i") + 1).alias("i"), "s.src", "s.dst")
    known = R.pair_levels(spark, sf_dir).withColumn("there", F.lit(True))
    return rows.join(known, ["pack", "src", "dst"], "left").select("pred_id", "i", "src", "dst", F.col("there").isNotNull().alias("given"), "level", "causal_type")


@query(r"SELECT h, count(*) AS rows, count(DISTINCT pack) AS packs, min(pack) AS first_pack FROM (SELECT pack, md5(lower(regexp_replace(text, '\s+', '', 'g'))) AS h FROM documents WHERE pack IS NOT NULL AND text IS NOT NULL) GROUP BY h HAVING count(DISTINCT pack) > 1")
def cross_pack_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that several packs hold."""
    d = table(spark, sf_dir, "documents").where("pack IS NOT NULL AND text IS NOT NULL").select("pack", F.md5(T.squeezed(F.col("text"))).alias("h"))
    return d.groupBy("h").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("pack").alias("packs"), F.min("pack").alias("first_pack")).where("packs > 1")


@query(base("SELECT sample_key, pack, count(*) AS views, array_to_string(list(track ORDER BY track), '') AS tracks FROM (SELECT DISTINCT sample_key, pack, 'A' AS track FROM preds1 UNION ALL SELECT DISTINCT sample_key, pack, 'B' FROM questions1 UNION ALL SELECT DISTINCT sample_key, pack, 'C' FROM gold1) GROUP BY ALL"))
def merged_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables merged by pack and sample."""
    part = lambda df, t: df.select("sample_key", "pack").distinct().withColumn("track", F.lit(t))
    every = part(R.predictions(spark, sf_dir), "A").unionByName(part(R.questions(spark, sf_dir), "B")).unionByName(part(R.gold(spark, sf_dir), "C"))
    return every.groupBy("sample_key", "pack").agg(F.count(F.lit(1)).alias("views"), F.array_join(F.array_sort(F.collect_list("track")), "").alias("tracks"))


@query(base("SELECT q.pack, q.pos, q.sample_key, e.event_id FROM questions1 AS q JOIN events1 AS e ON e.pack = q.pack AND e.pos = q.pos"))
def positional_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions and events of a pack at the same place in their files."""
    e = R.events(spark, sf_dir).select("pack", "pos", "event_id")
    return R.questions(spark, sf_dir).join(e, ["pack", "pos"]).select("pack", "pos", "sample_key", "event_id")


@query(base("SELECT a.sample_key, a.track, CASE WHEN a.track = 'A' THEN coalesce(b.answer, a.answer) ELSE a.answer END IS DISTINCT FROM a.answer AS changed, md5(CASE WHEN a.track = 'A' THEN coalesce(b.answer, a.answer) ELSE a.answer END) AS digest FROM preds1 AS a LEFT JOIN preds1 AS b ON b.sample_key = a.sample_key AND b.arm = 'guided' WHERE a.arm = 'base'"))
def substitution_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base predictions with track A taken from the guided arm where it has one."""
    p = R.predictions(spark, sf_dir)
    old, new = p.where("arm = 'base'").select("sample_key", "track", "answer"), p.where("arm = 'guided'").select("sample_key", "answer")
    return K.substitute(old, new, ["sample_key"], "answer", F.col("track") == "A").select("sample_key", "track", "changed", F.md5("answer").alias("digest"))


@query(base("SELECT (SELECT count(*) FROM (SELECT DISTINCT sample_key FROM questions1 EXCEPT SELECT sample_key FROM gold1)) AS only_a, (SELECT count(*) FROM (SELECT DISTINCT sample_key FROM gold1 EXCEPT SELECT sample_key FROM questions1)) AS only_b"))
def set_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples that only questions, or only gold, has."""
    return K.same_sets(R.questions(spark, sf_dir).select("sample_key").distinct(), R.gold(spark, sf_dir).select("sample_key").distinct())


@query(base("SELECT pack, event_id, min(place) AS place FROM (SELECT pack, src AS event_id, 0 AS place FROM edges1 UNION ALL SELECT pack, dst, 1 FROM edges1 UNION ALL SELECT pack, event_id, 2 FROM events1) GROUP BY pack, event_id"))
def ordered_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as causes, as effects and as listed; each once, where it first occurs."""
    e = R.edges(spark, sf_dir)
    parts = [e.select("pack", F.col("src").alias("event_id")), e.select("pack", F.col("dst").alias("event_id")), R.events(spark, sf_dir).select("pack", "event_id")]
    return K.ordered_union(parts, "event_id", "pack")


@query(base("SELECT pack, sha256(string_agg(sample_key, chr(10) ORDER BY sample_key)) AS digest, count(*) AS samples FROM questions1 GROUP BY pack"))
def id_list_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each pack's list of samples, as a lineage signature."""
    ids = F.array_join(F.array_sort(F.collect_list("sample_key")), "\n")
    return R.questions(spark, sf_dir).groupBy("pack").agg(F.sha2(ids, 256).alias("digest"), F.count(F.lit(1)).alias("samples"))


@query(base("SELECT count(DISTINCT pack) AS packs, count(*) AS questions, sum(len(chains))::BIGINT AS chains, count(*) FILTER (len(chains) > 1) AS multiple FROM gold1"))
def gold_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs, questions, chains and items with several chains in gold."""
    return R.gold(spark, sf_dir).agg(F.countDistinct("pack").alias("packs"), F.count(F.lit(1)).alias("questions"), F.sum(F.size("chains")).alias("chains"), F.count_if(F.size("chains") > 1).alias("multiple"))


@query(base("SELECT * EXCLUDE (n) FROM (SELECT track, sample_key, length(question) AS chars, row_number() OVER (PARTITION BY track ORDER BY length(question) DESC, sample_key) AS n FROM questions1) WHERE n <= 3"))
def topk_per_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three longest questions of each track."""
    n = F.row_number().over(Window.partitionBy("track").orderBy(F.desc("chars"), "sample_key"))
    return R.questions(spark, sf_dir).select("track", "sample_key", F.length("question").alias("chars")).withColumn("n", n).where("n <= 3").drop("n")


@query(base(f"SELECT pred_id, array_to_string({steps('chain')}, ',') AS steps, (SELECT count(*) FROM edges1 AS e WHERE e.pack = p.pack AND list_contains(p.chain, e.src) AND list_contains(p.chain, e.dst)) AS inner_edges FROM preds1 AS p"))
def chain_inner_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted chains with the number of given edges among their events."""
    p = R.predictions(spark, sf_dir).select("pred_id", "pack", "chain")
    e = R.edges(spark, sf_dir).select("pack", "src", "dst")
    inner = p.join(e, "pack").where(F.array_contains("chain", F.col("src")) & F.array_contains("chain", F.col("dst"))).groupBy("pred_id").agg(F.count(F.lit(1)).alias("n"))
    return p.join(inner, "pred_id", "left").select("pred_id", F.array_join(T.steps(F.col("chain")), ",").alias("steps"), F.coalesce("n", F.lit(0)).alias("inner_edges"))


@query(
    """SELECT user_id, epoch_us(run_start) AS start_us, epoch_us(run_end) AS end_us, samples FROM (SELECT user_id, min(ts) AS run_start, max(ts) AS run_end, count(*) AS samples FROM (
    SELECT *, sum((NOT ok)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT user_id, ts, event_id, coalesce(value <= 20, false) AS ok FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL)) WHERE ok GROUP BY user_id, island)
    WHERE epoch_us(run_end) - epoch_us(run_start) >= 43200 * 1000000::BIGINT"""
)
def idle_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of twelve hours or more in which no event of a user exceeds a value."""
    runs = gate(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "value", 20.0, 43200)
    return runs.select("user_id", epoch_micros(runs, "run_start").alias("start_us"), epoch_micros(runs, "run_end").alias("end_us"), "samples")
