"""Queries of retrieval and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.functions import text as T
from packloom.operators import retrieval as V
from packloom.operators.generate import generate, mock_model
from packloom.plans.sql import base, steps, tokens
from packloom.sources import relations as R
from packloom.sources.tables import table

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


@query(base("SELECT sample_key, pack, event_id, round(score, 4) AS score, rnk FROM rank1 WHERE rnk <= 5"))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best candidates of each question in its pack."""
    return V.ranked_candidates(spark, sf_dir).where("rnk <= 5").select("sample_key", "pack", "event_id", F.round("score", 4).alias("score"), "rnk")


_CHARS = r"list_distinct(regexp_extract_all({}, '[\x{{4e00}}-\x{{9fff}}]'))"


@query(
    base(
        rf"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample_key ORDER BY hybrid DESC, ord, event_id) AS rnk FROM (
          SELECT r.sample_key, r.ord, r.event_id, round(0.45 * r.relevance + 0.55 * coalesce(len(list_intersect(a, b)) / nullif(sqrt(len(a) * len(b)), 0), 0.0), 8) AS hybrid
          FROM ranked AS r JOIN (SELECT sample_key, {_CHARS.format("question")} AS a FROM questions1) USING (sample_key)
          JOIN (SELECT pack, event_id, {_CHARS.format("text")} AS b FROM cand) AS c ON c.pack = r.pack AND c.event_id = r.event_id)) WHERE rnk <= 5"""
    )
)
def hybrid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion of BM25 with a cosine; here the cosine of the sets of ideographs, in the place of an encoder's."""
    chars = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit(r"([\x{4e00}-\x{9fff}])"), F.lit(1)))
    q = R.questions(spark, sf_dir).select("sample_key", "pack", chars(F.col("question")).alias("a"))
    c = R.candidates(spark, sf_dir).select("pack", "event_id", chars(F.col("text")).alias("b"))
    cosine = F.size(F.array_intersect("a", "b")) / F.nullif(F.sqrt(F.size("a") * F.size("b")), F.lit(0.0))
    semantic = q.join(c, "pack").select("sample_key", "event_id", F.coalesce(cosine, F.lit(0.0)).alias("cosine"))
    r = V.ranked_candidates(spark, sf_dir, 0.45, semantic)
    return r.where("rnk <= 5").select("sample_key", "ord", "event_id", F.col("relevance").alias("hybrid"), "rnk")


@query(
    """SELECT query_id, vec_id, cosine, rnk FROM (
      SELECT q.vec_id AS query_id, e.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cosine,
             row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) DESC, e.vec_id) AS rnk
      FROM embeddings AS q JOIN embeddings AS e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0) WHERE rnk <= 5"""
)
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar vectors of each vector whose id is divisible by 20."""
    v = table(spark, sf_dir, "embeddings").withColumn("vec_id", F.col("vec_id").cast("bigint"))
    return V.cosine_topk(v, "vec_id", "embedding", v.where("vec_id % 20 = 0"))


@query(f"SELECT doc_id, len(t) AS n_tokens, len(list_distinct(t)) AS n_terms FROM (SELECT doc_id, {tokens('text')} AS t FROM documents WHERE text IS NOT NULL)")
def tokens_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, and different tokens, of each document."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.tokens(F.col("text")).alias("t"))
    return d.select("doc_id", F.size("t").alias("n_tokens"), F.size(F.array_distinct("t")).alias("n_terms"))


@query(base("SELECT sample_key, array_to_string(ids, ',') AS ids FROM anchors1"))
def event_id_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ids of each question, first mention first."""
    return R.questions(spark, sf_dir).select("sample_key", F.array_join(T.event_ids(F.col("question")), ",").alias("ids"))


@query(
    base(
        r"""SELECT sample_key, len(regexp_extract_all(regexp_replace(question, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])(D[0-9]{3,})(?:$|[^\p{L}\p{N}_])', 1)) AS bounded,
        len(regexp_extract_all(question, 'D[0-9]{3,}')) AS unbounded FROM questions1"""
    )
)
def event_id_bounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event ids with and without a word boundary around them."""
    q = R.questions(spark, sf_dir)
    return q.select("sample_key", F.size(T.bounded_event_ids(F.col("question"))).alias("bounded"), F.regexp_count("question", F.lit(T.EVENT_ID)).alias("unbounded"))


_SENTENCES = r"list_filter(list_transform(string_split_regex(regexp_replace({0}, '([。！？；;])', '\1' || chr(10), 'g'), '\n+'), lambda s: regexp_replace(s, '^[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')), lambda s: s <> '')"


@query(
    f"""SELECT doc_id, len(s) AS sentences, len(list_filter(s, lambda x: length(x) BETWEEN 8 AND 250)) AS kept, md5(array_to_string(s, '|')) AS digest
    FROM (SELECT doc_id, {_SENTENCES.format("text")} AS s FROM documents WHERE text IS NOT NULL)"""
)
def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of each document, how many are of use as evidence, and a digest of them."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", T.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("sentences"), F.size(F.filter("s", lambda x: F.length(x).between(8, 250))).alias("kept"), F.md5(F.array_join("s", "|")).alias("digest"))


@query(r"SELECT doc_id, sha256(lower(regexp_replace(text, '\s+', '', 'g'))) AS digest FROM documents WHERE text IS NOT NULL")
def normalized_doc_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of each document without layout and case."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.sha2(T.squeezed(F.col("text")), 256).alias("digest"))


@query(base("SELECT pack, ord, event_id, doc_id, label, md5(text) AS digest, length(text) AS chars FROM cand"))
def candidate_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates with the digest of their text."""
    return R.candidates(spark, sf_dir).select("pack", "ord", "event_id", "doc_id", "label", F.md5("text").alias("digest"), F.length("text").alias("chars"))


@query(
    base(
        """SELECT q.sample_key, regexp_replace(q.pack, '_[^_]*$', '') AS domain,
        CASE WHEN len(ids) > 0 AND regexp_matches(question, '""" + T.DIRECT_DOWN + """') THEN 'direct_down'
             WHEN len(ids) > 0 AND regexp_matches(question, '""" + T.DIRECT_UP + """') THEN 'direct_up'
             WHEN len(ids) >= 2 AND kind = 'counterfactual' THEN 'from_to'
             WHEN len(ids) > 0 AND kind = 'prospective' THEN 'future'
             WHEN len(ids) > 0 AND kind = 'retrospective' THEN 'upstream' ELSE 'general' END AS intent
        FROM questions1 AS q JOIN known1 AS k USING (sample_key)"""
    )
)
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domain of each question and what it asks of the graph."""
    rows = R.questions(spark, sf_dir).join(V.known_anchors(spark, sf_dir).drop("pack"), "sample_key")
    return rows.select("sample_key", T.domain(F.col("pack")).alias("domain"), T.question_intent(F.col("question"), F.col("kind"), F.col("ids")).alias("intent"))


_REST = "substr(question, instr(question, ids[1]) + length(ids[1]))"


@query(
    base(
        f"""SELECT sample_key, CASE WHEN kind <> 'retrospective' OR kind IS NULL THEN NULL
        WHEN len(ids) = 2 AND regexp_matches(question, '{T.TEMPORAL}') AND regexp_matches(question, '{T.CAUSAL_ASK}') THEN 'temporal_causal_pair'
        WHEN len(ids) = 1 AND regexp_matches({_REST}, '{T.FORWARD_DIRECT}') THEN 'direct_effect'
        WHEN len(ids) = 1 AND regexp_matches(question, '{T.FACTS}') AND NOT regexp_matches(question, '{T.PROCESS}') THEN 'event_facts'
        WHEN len(ids) = 1 AND regexp_matches({_REST}, '{T.UNSPECIFIED}') THEN 'unspecified_direct' END AS intent,
        CASE WHEN list_contains(ids, regexp_extract(question, '{T.PAIR_ROLE}', 1)) AND list_contains(ids, regexp_extract(question, '{T.PAIR_ROLE}', 2)) THEN regexp_extract(question, '{T.PAIR_ROLE}', 1)
             WHEN NOT list_contains(ids, regexp_extract(question, '{T.END_ROLE}', 1)) AND list_contains(ids, regexp_extract(question, '{T.START_ROLE}', 1)) THEN regexp_extract(question, '{T.START_ROLE}', 1) END AS start_event,
        CASE WHEN list_contains(ids, regexp_extract(question, '{T.PAIR_ROLE}', 1)) AND list_contains(ids, regexp_extract(question, '{T.PAIR_ROLE}', 2)) THEN regexp_extract(question, '{T.PAIR_ROLE}', 2)
             WHEN list_contains(ids, regexp_extract(question, '{T.END_ROLE}', 1)) THEN regexp_extract(question, '{T.END_ROLE}', 1) END AS end_event
        FROM questions1 JOIN known1 USING (sample_key)"""
    )
)
def targeted_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow intents, and the events that the wording makes start and end."""
    rows = R.questions(spark, sf_dir).join(V.known_anchors(spark, sf_dir).drop("pack"), "sample_key")
    question, ids = F.col("question"), F.col("ids")
    return rows.select("sample_key", T.targeted_intent(question, F.col("kind"), ids).alias("intent"), T.role(question, ids, "start").alias("start_event"), T.role(question, ids, "end").alias("end_event"))


@query(
    base(
        f"""SELECT pred_id, array_to_string({steps("chain")}, ',') AS steps, CASE WHEN len(chain) <= 2 THEN len(chain)::VARCHAR ELSE '3+' END AS bucket,
        len(list_filter(list_zip(chain[1:len(chain)-1], chain[2:len(chain)]), lambda z: try_cast(nullif(regexp_extract(z[2], 'D([0-9]+)', 1), '') AS INT) < try_cast(nullif(regexp_extract(z[1], 'D([0-9]+)', 1), '') AS INT))) > 0 AS reversed
        FROM preds1"""
    )
)
def chain_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps, length bucket and order of each predicted chain."""
    c = F.col("chain")
    return R.predictions(spark, sf_dir).select("pred_id", F.array_join(T.steps(c), ",").alias("steps"), T.length_bucket(c).alias("bucket"), F.coalesce(T.nonmonotonic(c), F.lit(False)).alias("reversed"))


@query(
    base(
        f"""SELECT sample_key, event_id, left(coalesce(arg_max(s, (sc, -i)), ''), 240) AS excerpt FROM (
      SELECT x.sample_key, x.event_id, x.i, x.s, round(coalesce(sum(CASE WHEN t.tf IS NOT NULL THEN ln(1 + (x.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (0.25 + 0.75 * x.dl / x.mean)) END), 0.0), 6) AS sc
      FROM (SELECT *, count(i) OVER w AS n, CASE WHEN sum(dl) OVER w = 0 THEN 1.0 ELSE avg(dl) OVER w END AS mean FROM sent1 WINDOW w AS (PARTITION BY sample_key, event_id)) AS x
      LEFT JOIN asked1 AS a ON a.sample_key = x.sample_key AND a.event_id = x.event_id
      LEFT JOIN stf AS t ON t.sample_key = x.sample_key AND t.event_id = x.event_id AND t.i = x.i AND t.term = a.term
      LEFT JOIN sdf AS d ON d.sample_key = x.sample_key AND d.event_id = x.event_id AND d.term = a.term
      GROUP BY ALL) GROUP BY sample_key, event_id""",
        f"""sent1 AS (SELECT r.sample_key, r.event_id, u.i, u.s, len(u.toks) AS dl, u.toks FROM (SELECT r.sample_key, r.event_id, c.pack, c.doc_id FROM rank1 AS r JOIN cand AS c ON c.pack = r.pack AND c.event_id = r.event_id WHERE r.rnk = 1) AS r
          LEFT JOIN (SELECT pack, doc_code, i, s, {tokens("s")} AS toks FROM (SELECT pack, doc_code, unnest(range(0, len(l))) AS i, unnest(l) AS s FROM (SELECT pack, doc_code, {_SENTENCES.format("text")} AS l FROM docs1))) AS u ON u.pack = r.pack AND u.doc_code = r.doc_id),
        asked1 AS (SELECT DISTINCT sample_key, event_id, unnest(toks) AS term FROM (SELECT r.sample_key, r.event_id, {tokens("q.question || ' ' || c.label")} AS toks FROM rank1 AS r JOIN questions1 AS q USING (sample_key) JOIN cand AS c ON c.pack = r.pack AND c.event_id = r.event_id WHERE r.rnk = 1)),
        stf AS (SELECT sample_key, event_id, i, term, count(*) AS tf FROM (SELECT sample_key, event_id, i, unnest(toks) AS term FROM sent1) GROUP BY ALL),
        sdf AS (SELECT sample_key, event_id, term, count(*) AS df FROM stf GROUP BY ALL)""",
    )
)
def best_excerpt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best sentence of each question's first candidate."""
    asked = V.ranked_candidates(spark, sf_dir).where("rnk = 1").select("sample_key", "pack", "event_id")
    return V.best_excerpts(spark, sf_dir, asked)


@query(
    base(
        """SELECT sample_key, event_id, row_number() OVER (PARTITION BY sample_key ORDER BY first) AS place, CASE WHEN anchor = 1 THEN 'ranked+question_anchor' ELSE 'ranked' END AS source FROM (
        SELECT sample_key, event_id, min(place) AS first, max(anchor) AS anchor FROM (
          SELECT sample_key, event_id, rnk AS place, 0 AS anchor FROM rank1 WHERE rnk <= 3
          UNION ALL SELECT sample_key, ids[i], 3 + i, 1 FROM (SELECT sample_key, ids, unnest(range(1, len(ids) + 1)) AS i FROM known1)) GROUP BY sample_key, event_id)"""
    )
)
def hints_union_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The top three candidates of each question and its anchors."""
    return V.hints(spark, sf_dir)


@query(
    base(
        """SELECT q.sample_key, count(*) AS documents, sum(length(d.text))::BIGINT AS chars, md5(string_agg(d.doc_code, ',' ORDER BY d.doc_code)) AS digest FROM questions1 AS q JOIN docs1 AS d ON d.pack = q.pack
        SEMI JOIN (SELECT r.sample_key, c.doc_id FROM rank1 AS r JOIN cand AS c ON c.pack = r.pack AND c.event_id = r.event_id WHERE r.rnk <= 3
              UNION SELECT sample_key, unnest(ids) FROM anchors1) AS k ON k.sample_key = q.sample_key AND k.doc_id = d.doc_code GROUP BY q.sample_key"""
    )
)
def rag_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents chosen for each question: those of the top candidates and those it names."""
    q, docs = R.questions(spark, sf_dir), R.documents(spark, sf_dir)
    c = R.candidates(spark, sf_dir).select("pack", "event_id", "doc_id")
    top = V.ranked_candidates(spark, sf_dir).where("rnk <= 3").join(c, ["pack", "event_id"]).select("sample_key", "pack", F.col("doc_id").alias("doc_code"))
    named = q.select("sample_key", "pack", F.explode(T.event_ids(F.col("question"))).alias("doc_code"))
    chosen = top.unionByName(named).distinct().join(docs, ["pack", "doc_code"])
    return chosen.groupBy("sample_key").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.length("text")).alias("chars"), F.md5(F.array_join(F.array_sort(F.collect_list("doc_code")), ",")).alias("digest"))


_ALTERNATIVES = "(SELECT sample_key, pack, chain, row_number() OVER () AS alt FROM (SELECT sample_key, pack, unnest(list_filter(chains, lambda x: len(x) > 0)) AS chain FROM gold1))"


@query(
    base(
        f"""SELECT coalesce(kind, '') AS kind, k, count(*) AS samples, round(avg(recall), 4) AS recall, round(avg((recall = 1)::INT), 4) AS full_chain, grouping(kind) AS total FROM (
        SELECT q.sample_key, q.kind, k, max(r) AS recall FROM (
          SELECT a.sample_key, a.alt, k, sum((rk.rnk <= k)::INT) / count(*) AS r FROM (SELECT sample_key, pack, alt, unnest(list_distinct(chain)) AS event_id FROM {_ALTERNATIVES}) AS a
          CROSS JOIN (VALUES (1), (2), (3), (5)) AS v(k) LEFT JOIN rank1 AS rk ON rk.sample_key = a.sample_key AND rk.event_id = a.event_id GROUP BY ALL) JOIN questions1 AS q USING (sample_key) GROUP BY ALL)
        GROUP BY GROUPING SETS ((k), (kind, k))"""
    )
)
def recall_at_k_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best recall of a gold alternative among the top 1, 2, 3 and 5 candidates, in all and by question kind."""
    alternatives = R.gold(spark, sf_dir).select("sample_key", F.posexplode(F.filter("chains", lambda x: F.size(x) > 0)).alias("alt", "chain"))
    nodes = alternatives.select("sample_key", "alt", F.explode(F.array_distinct("chain")).alias("event_id"))
    ranks = V.ranked_candidates(spark, sf_dir).select("sample_key", "event_id", "rnk")
    at = nodes.join(ranks, ["sample_key", "event_id"], "left").groupBy("sample_key", "alt").agg(*[(F.count_if(F.col("rnk") <= k) / F.count(F.lit(1))).alias(f"r{k}") for k in (1, 2, 3, 5)])
    best = at.groupBy("sample_key").agg(*[F.max(f"r{k}").alias(f"r{k}") for k in (1, 2, 3, 5)])
    long = best.select("sample_key", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"r{k}").alias("recall")) for k in (1, 2, 3, 5)])).alias("x")).select("sample_key", "x.*")
    rows = long.join(R.questions(spark, sf_dir).select("sample_key", "kind"), "sample_key")
    out = rows.groupingSets([["k"], ["kind", "k"]], "kind", "k").agg(
        F.count(F.lit(1)).alias("samples"), F.round(F.avg("recall"), 4).alias("recall"), F.round(F.avg((F.col("recall") == 1).cast("int")), 4).alias("full_chain"), F.grouping("kind").cast("bigint").alias("total")
    )
    return out.withColumn("kind", F.coalesce("kind", F.lit("")))


@query()
def answer_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarity of the answers of both arms to a question."""
    p = R.predictions(spark, sf_dir)
    base_arm, other = p.where("arm = 'base'").select("sample_key", F.col("answer").alias("a")), p.where("arm = 'guided'").select("sample_key", F.col("answer").alias("b"))
    return base_arm.join(other, "sample_key").select("sample_key", F.round(T.similarity("a", "b"), 4).alias("similarity"))


@query(
    base(
        """SELECT r.sample_key, r.event_id, r.relevance, r.rnk AS place, round(1.0 / r.rnk, 6) AS reciprocal, coalesce(list_contains(k.ids, r.event_id), false)::INT AS anchor,
        coalesce(i.n, 0) AS indegree, coalesce(o.n, 0) AS outdegree, length(c.label) AS label_chars, (instr(q.question, c.label) > 0)::INT AS label_in_question,
        (q.kind = 'retrospective')::INT AS retrospective, (q.kind = 'prospective')::INT AS prospective, (q.kind = 'counterfactual')::INT AS counterfactual, (q.kind = 'unanswerable')::INT AS unanswerable
        FROM rank1 AS r JOIN questions1 AS q USING (sample_key) JOIN known1 AS k USING (sample_key) JOIN cand AS c ON c.pack = r.pack AND c.event_id = r.event_id
        LEFT JOIN (SELECT pack, dst, count(*) AS n FROM edges1 GROUP BY ALL) AS i ON i.pack = r.pack AND i.dst = r.event_id
        LEFT JOIN (SELECT pack, src, count(*) AS n FROM edges1 GROUP BY ALL) AS o ON o.pack = r.pack AND o.src = r.event_id"""
    )
)
def ranking_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numeric features of each question and candidate, for a learned ranker."""
    e = R.edges(spark, sf_dir)
    indegree = e.groupBy("pack", F.col("dst").alias("event_id")).agg(F.count(F.lit(1)).alias("indegree"))
    outdegree = e.groupBy("pack", F.col("src").alias("event_id")).agg(F.count(F.lit(1)).alias("outdegree"))
    rows = V.ranked_candidates(spark, sf_dir).join(R.questions(spark, sf_dir).select("sample_key", "question", "kind"), "sample_key").join(V.known_anchors(spark, sf_dir).drop("pack"), "sample_key")
    rows = rows.join(R.candidates(spark, sf_dir).select("pack", "event_id", "label"), ["pack", "event_id"]).join(indegree, ["pack", "event_id"], "left").join(outdegree, ["pack", "event_id"], "left")
    kinds = [(F.col("kind") == k).cast("int").alias(k) for k in ("retrospective", "prospective", "counterfactual", "unanswerable")]
    return rows.select(
        "sample_key",
        "event_id",
        "relevance",
        F.col("rnk").alias("place"),
        F.round(1.0 / F.col("rnk"), 6).alias("reciprocal"),
        F.array_contains("ids", F.col("event_id")).cast("int").alias("anchor"),
        F.coalesce("indegree", F.lit(0)).alias("indegree"),
        F.coalesce("outdegree", F.lit(0)).alias("outdegree"),
        F.length("label").alias("label_chars"),
        F.contains("question", "label").cast("int").alias("label_in_question"),
        *kinds,
    )


@query()
def mock_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checked replies of a stand-in generator to every question."""
    allowed = R.candidates(spark, sf_dir).groupBy("pack").agg(F.collect_set("event_id").alias("allowed"))
    prompts = R.questions(spark, sf_dir).join(allowed, "pack", "left").select("sample_key", F.col("question").alias("prompt"), "allowed")
    return generate(prompts, mock_model).select("sample_key", "rounds", "error", "answer")
