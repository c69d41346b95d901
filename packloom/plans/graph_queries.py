"""Queries over the causal graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.functions import text as T
from packloom.operators import graph as G
from packloom.operators.components import propagate
from packloom.operators.retrieval import known_anchors, ranked_candidates
from packloom.plans.sql import base, bm25, steps
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


@query(
    base(
        """SELECT e.pack, e.event_id, coalesce(i.n, 0)::BIGINT AS indegree, coalesce(o.n, 0)::BIGINT AS outdegree FROM events1 AS e
        LEFT JOIN (SELECT pack, dst, count(*) AS n FROM edges1 GROUP BY ALL) AS i ON i.pack = e.pack AND i.dst = e.event_id
        LEFT JOIN (SELECT pack, src, count(*) AS n FROM edges1 GROUP BY ALL) AS o ON o.pack = e.pack AND o.src = e.event_id"""
    )
)
def graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges into and out of each event."""
    return G.degrees(spark, sf_dir)


@query(base("SELECT pack, array_to_string(path, '>') AS path FROM paths1"))
def simple_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every simple path of every pack."""
    return G.pack_paths(spark, sf_dir).select("pack", G.joined("path").alias("path"))


_ROOTS = """roots1 AS (
  SELECT e.pack, e.event_id FROM (SELECT *, count(*) FILTER (NOT fed) OVER (PARTITION BY pack) AS free FROM (
    SELECT e.pack, e.event_id, i.dst IS NOT NULL AS fed FROM events1 AS e LEFT JOIN (SELECT DISTINCT pack, dst FROM edges1) AS i ON i.pack = e.pack AND i.dst = e.event_id)) AS e WHERE NOT fed OR free = 0),
target1 AS (SELECT sample_key, pack, ids[-1] AS target FROM known1 WHERE len(ids) > 0)"""


@query(
    base(
        """SELECT t.sample_key, array_to_string(p.path, '>') AS path FROM target1 AS t JOIN paths1 AS p ON p.pack = t.pack AND p.path[-1] = t.target AND len(p.path) <= 12
        SEMI JOIN roots1 AS r ON r.pack = p.pack AND r.event_id = p.path[1]""",
        _ROOTS,
    )
)
def paths_to_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths from a root of the pack to the last event that a question names; where every event is fed, all are roots."""
    d = G.degrees(spark, sf_dir).withColumn("free", F.sum((F.col("indegree") == 0).cast("int")).over(Window.partitionBy("pack")))
    roots = d.where("indegree = 0 OR free = 0").select("pack", F.col("event_id").alias("begin"))
    target = known_anchors(spark, sf_dir).where(F.size("ids") > 0).select("sample_key", "pack", F.element_at("ids", -1).alias("end"))
    paths = G.pack_paths(spark, sf_dir, G.MOST_NODES).select("pack", "path", F.element_at("path", 1).alias("begin"), F.element_at("path", -1).alias("end"))
    return target.join(paths, ["pack", "end"]).join(roots, ["pack", "begin"], "left_semi").select("sample_key", G.joined("path").alias("path"))


@query(
    base(
        """SELECT sample_key, array_to_string(path, '>') AS path, rnk FROM (SELECT *, row_number() OVER (PARTITION BY sample_key ORDER BY cover DESC, mean DESC, len(path) DESC, array_to_string(path, '>')) AS rnk FROM (
        SELECT k.sample_key, p.path, round(len(list_intersect(k.ids, p.path)) / greatest(1, len(k.ids)), 6) AS cover, round(avg(coalesce(r.relevance, 0.0)), 6) AS mean
        FROM known1 AS k JOIN (SELECT pack, path, unnest(path) AS event_id FROM most1) AS p ON p.pack = k.pack LEFT JOIN ranked AS r ON r.sample_key = k.sample_key AND r.event_id = p.event_id GROUP BY ALL)) WHERE rnk <= 3""",
        """ids1 AS (SELECT DISTINCT c.pack, c.event_id FROM cand AS c SEMI JOIN edges0 AS z ON z.pack = c.pack),
        start1 AS (SELECT pack, event_id FROM (SELECT i.*, e.dst IS NOT NULL AS fed, count(*) FILTER (e.dst IS NULL) OVER (PARTITION BY i.pack) AS free FROM ids1 AS i LEFT JOIN (SELECT DISTINCT pack, dst FROM edges1) AS e ON e.pack = i.pack AND e.dst = i.event_id) WHERE NOT fed OR free = 0),
        from1 AS (SELECT pack, [event_id] AS path FROM start1 UNION ALL SELECT p.pack, list_append(p.path, e.dst) FROM from1 AS p JOIN (SELECT DISTINCT pack, src, dst FROM edges1) AS e ON e.pack = p.pack AND e.src = p.path[-1] WHERE NOT list_contains(p.path, e.dst) AND len(p.path) < 12),
        most1 AS (SELECT p.* FROM from1 AS p LEFT JOIN (SELECT DISTINCT pack, src FROM edges1) AS e ON e.pack = p.pack AND e.src = p.path[-1] WHERE e.src IS NULL OR len(p.path) = 12)""",
    )
)
def graph_path_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best maximal paths of the pack for each question."""
    return G.path_hints(spark, sf_dir)


_WEIGHT = "CASE level WHEN 'certain' THEN 1.0 WHEN 'probable' THEN 0.7 WHEN 'possible' THEN 0.4 ELSE 0.7 END"


@query(
    base(
        f"""SELECT pack, path, round(sum(w), 6) AS strength FROM (
        SELECT p.pack, array_to_string(p.path, '>') AS path, coalesce(CASE WHEN e.src IS NOT NULL THEN {_WEIGHT} END, 0.5)::DOUBLE AS w
        FROM (SELECT pack, path, unnest(range(1, len(path))) AS i FROM paths1) AS p LEFT JOIN pairs1 AS e ON e.pack = p.pack AND e.src = p.path[p.i] AND e.dst = p.path[p.i + 1]) GROUP BY ALL"""
    )
)
def path_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed weights of the steps of every path."""
    rows = G.path_strength(G.pack_paths(spark, sf_dir), R.pair_levels(spark, sf_dir))
    return rows.select("pack", G.joined("path").alias("path"), "strength")


_NODE_MEANS = """nodes1 AS (
  SELECT q.sample_key, p.pack, p.path, round(avg(coalesce(r.relevance, 0.0)), 6) AS mean FROM questions1 AS q JOIN (SELECT pack, path, unnest(path) AS event_id FROM paths1 WHERE len(path) BETWEEN 2 AND 10) AS p ON p.pack = q.pack
  LEFT JOIN ranked AS r ON r.sample_key = q.sample_key AND r.event_id = p.event_id GROUP BY ALL)"""
_INTENT = f"""CASE WHEN len(ids) > 0 AND regexp_matches(question, '{T.DIRECT_DOWN}') THEN path[1] = ids[1] AND len(path) = 2
  WHEN len(ids) > 0 AND regexp_matches(question, '{T.DIRECT_UP}') THEN path[-1] = ids[1] AND len(path) = 2
  WHEN len(ids) >= 2 AND kind = 'counterfactual' THEN path[1] = ids[1] AND path[-1] = ids[-1]
  WHEN len(ids) > 0 AND kind = 'prospective' THEN path[1] = ids[-1] AND NOT list_contains(ids, path[-1])
  WHEN len(ids) > 0 AND kind = 'retrospective' THEN path[-1] = ids[1] ELSE false END"""


@query(
    base(
        f"""SELECT sample_key, path, rnk FROM (SELECT n.sample_key, array_to_string(path, '>') AS path, row_number() OVER (PARTITION BY n.sample_key ORDER BY ({_INTENT})::INT DESC,
        round(len(list_intersect(ids, path)) / greatest(1, len(ids)), 6) DESC, mean DESC, CASE WHEN regexp_matches(question, '完整|多跳|连锁|传导') THEN len(path) ELSE -len(path) END DESC, array_to_string(path, '>')) AS rnk
        FROM nodes1 AS n JOIN questions1 AS q USING (sample_key) JOIN known1 AS k USING (sample_key)) WHERE rnk <= 5""",
        _NODE_MEANS,
    )
)
def question_conditioned_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five path segments that suit each question best."""
    return G.conditioned_paths(spark, sf_dir)


_EVENT_TEXT = "coalesce(event_type, '') || ' ' || coalesce(trigger_word, '') || ' ' || left(coalesce(array_to_string(map_values(argument), '；'), ''), 400) || ' ' || left(coalesce(d.text, ''), 400)"
SCORED = (
    bm25("sem", "SELECT sample_key AS query, pack AS corpus, regexp_replace(question, 'D[0-9]{3,}', ' ', 'g') AS text FROM questions1", f"SELECT e.pack AS corpus, e.event_id AS item, {_EVENT_TEXT} AS text FROM events1 AS e LEFT JOIN docs1 AS d ON d.pack = e.pack AND d.doc_code = e.doc_id")
    + f""",
semr AS (SELECT query AS sample_key, item AS event_id, round(score / max(score) OVER (PARTITION BY query), 6) AS relevance FROM sem),
role1 AS (SELECT sample_key, question, ids,
  CASE WHEN list_contains(ids, a) AND list_contains(ids, b) THEN a WHEN NOT list_contains(ids, e) AND list_contains(ids, s) THEN s END AS start_event,
  CASE WHEN list_contains(ids, a) AND list_contains(ids, b) THEN b WHEN list_contains(ids, e) THEN e END AS end_event
  FROM (SELECT sample_key, question, ids, regexp_extract(question, '{T.PAIR_ROLE}', 1) AS a, regexp_extract(question, '{T.PAIR_ROLE}', 2) AS b, regexp_extract(question, '{T.END_ROLE}', 1) AS e, regexp_extract(question, '{T.START_ROLE}', 1) AS s
    FROM questions1 JOIN known1 USING (sample_key))),
scored1 AS (SELECT n.sample_key, n.pack, n.path, round(
    1.5 * coalesce(r.start_event = path[1], false)::INT + 1.5 * coalesce(r.end_event = path[-1], false)::INT
    + CASE WHEN len(ids) BETWEEN 1 AND 2 THEN 0.6::DOUBLE * len(list_intersect(ids, path)) / len(ids) ELSE 0.0 END
    + (0.45::DOUBLE * first + 0.45::DOUBLE * last + 0.10::DOUBLE * best)
    + CASE WHEN regexp_matches(question, '{T.DIRECT}') THEN CASE WHEN len(path) = 2 THEN 0.3 ELSE 0.0 END WHEN regexp_matches(question, '{T.PROCESS}') THEN 0.08::DOUBLE * least(len(path) - 1, 6) ELSE -0.03::DOUBLE * (len(path) - 1) END, 8) AS score
  FROM (SELECT q.sample_key, p.pack, p.path, max(CASE WHEN p.event_id = p.path[1] THEN coalesce(s.relevance, 0.0) END) AS first, max(CASE WHEN p.event_id = p.path[-1] THEN coalesce(s.relevance, 0.0) END) AS last, max(coalesce(s.relevance, 0.0)) AS best
    FROM questions1 AS q JOIN (SELECT pack, path, unnest(path) AS event_id FROM paths1) AS p ON p.pack = q.pack LEFT JOIN semr AS s ON s.sample_key = q.sample_key AND s.event_id = p.event_id GROUP BY ALL) AS n JOIN role1 AS r USING (sample_key))"""
)


@query(base("SELECT sample_key, array_to_string(path, '>') AS path, score, rnk FROM (SELECT *, row_number() OVER (PARTITION BY sample_key ORDER BY score DESC, array_to_string(path, '>')) AS rnk FROM scored1) WHERE rnk <= 5", SCORED))
def path_score_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five paths of the highest score for each question."""
    order = Window.partitionBy("sample_key").orderBy(F.desc("score"), G.joined("path"))
    rows = G.scored_paths(spark, sf_dir).withColumn("rnk", F.row_number().over(order)).where("rnk <= 5")
    return rows.select("sample_key", G.joined("path").alias("path"), "score", "rnk")


@query()
def mmr_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five paths for each question, chosen for score and diversity."""
    return G.diverse_paths(G.scored_paths(spark, sf_dir))


@query()
def targeted_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five paths for each question, what is clearly asked for first."""
    return G.targeted_paths(spark, sf_dir)


@query(
    base(
        """SELECT pred_id, CASE WHEN steps = 0 THEN 0.5 WHEN certain = steps THEN 0.9 WHEN likely = steps THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence, steps, supported FROM (
        SELECT p.pred_id, count(i) AS steps, count(*) FILTER (e.level = 'certain') AS certain, count(*) FILTER (e.level IN ('certain', 'probable')) AS likely, count(e.src) AS supported
        FROM (SELECT pred_id, pack, chain, unnest(CASE WHEN len(chain) > 1 THEN range(1, len(chain)) ELSE [NULL] END) AS i FROM preds1) AS p LEFT JOIN pairs1 AS e ON e.pack = p.pack AND e.src = p.chain[p.i] AND e.dst = p.chain[p.i + 1] GROUP BY p.pred_id)"""
    )
)
def chain_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence that the levels of a predicted chain's steps allow, and how many steps the graph has."""
    n = F.greatest(F.size("chain") - 1, F.lit(0))
    step = F.explode_outer(F.zip_with(F.slice("chain", F.lit(1), n), F.slice("chain", F.lit(2), n), lambda a, b: F.struct(a.alias("src"), b.alias("dst"))))
    rows = R.predictions(spark, sf_dir).select("pred_id", "pack", step.alias("s")).select("pred_id", "pack", "s.src", "s.dst")
    known = R.pair_levels(spark, sf_dir).withColumn("there", F.lit(1))
    c = rows.join(known, ["pack", "src", "dst"], "left").groupBy("pred_id").agg(
        F.count("src").alias("steps"), F.count_if(F.col("level") == "certain").alias("certain"), F.count_if(F.col("level").isin("certain", "probable")).alias("likely"), F.count("there").alias("supported")
    )
    confidence = F.when(F.col("steps") == 0, 0.5).when(F.col("certain") == F.col("steps"), 0.9).when(F.col("likely") == F.col("steps"), 0.7).otherwise(0.5)
    return c.select("pred_id", confidence.alias("confidence"), "steps", "supported")


@query(
    base(
        """SELECT pred_id, array_to_string(chain[l:r], '>') AS part FROM (SELECT pred_id, chain, l, unnest(range(l, len(chain) + 1)) AS r FROM (SELECT pred_id, chain, unnest(range(1, len(chain) + 1)) AS l FROM preds1)) WHERE r - l + 1 < len(chain)"""
    )
)
def chain_subsequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts in one piece of each predicted chain."""
    return R.predictions(spark, sf_dir).select("pred_id", F.explode(G.contiguous_trims(F.col("chain"))).alias("part")).select("pred_id", G.joined("part").alias("part"))


_CANDIDATES = """drafts1 AS (SELECT p.pred_id, p.chain, k.ids, coalesce(l.links, []) AS links FROM preds1 AS p JOIN known1 AS k USING (sample_key)
  LEFT JOIN (SELECT pack, list([src, dst] ORDER BY pos, src, dst) AS links FROM edges1 GROUP BY pack) AS l ON l.pack = p.pack),
every1 AS (
  SELECT pred_id, 0 AS part, 0 AS a, 0 AS b, NULL::BIGINT[] AS p, chain AS c FROM drafts1
  UNION ALL SELECT pred_id, 1, l, -r, NULL, chain[l:r] FROM (SELECT *, unnest(range(l, len(chain) + 1)) AS r FROM (SELECT *, unnest(range(1, len(chain) + 1)) AS l FROM drafts1)) WHERE r - l + 1 < len(chain)
  UNION ALL SELECT pred_id, 2, -len(p), 0, p, list_transform(p, lambda i: chain[i]) FROM (SELECT *, list_filter(range(1, len(chain) + 1), lambda i: (m >> (i - 1)) % 2 = 1) AS p FROM (SELECT *, unnest(range(1, 1 << len(chain))) AS m FROM drafts1 WHERE len(chain) BETWEEN 3 AND 7)) WHERE len(p) >= 2 AND len(p) < len(chain) AND p[-1] - p[1] + 1 > len(p)
  UNION ALL SELECT pred_id, 3, i, 0, NULL, [ids[i]] FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS i FROM drafts1)
  UNION ALL SELECT pred_id, 4, i, 0, NULL, links[i] FROM (SELECT *, unnest(range(1, len(links) + 1)) AS i FROM drafts1) WHERE list_has_any(links[i], ids)),
skips1 AS (SELECT *, CASE WHEN part = 2 THEN row_number() OVER (PARTITION BY pred_id, part ORDER BY a, p) ELSE 0 END AS z FROM every1),
first1 AS (SELECT pred_id, c, min(part * 1000000 + CASE part WHEN 1 THEN a * 1000 + 500 + b WHEN 2 THEN z ELSE a END) AS placed FROM skips1 WHERE len(c) > 0 AND len(list_distinct(c)) = len(c) GROUP BY ALL)"""


@query(base("SELECT pred_id, (nth - 1)::INT AS place, array_to_string(c, '>') AS chain FROM (SELECT *, row_number() OVER (PARTITION BY pred_id ORDER BY placed) AS nth FROM first1) WHERE nth <= 16", _CANDIDATES))
def chain_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chains to check beside each prediction's, sixteen at most."""
    links = R.edges(spark, sf_dir).select("pack", "pos", F.array("src", "dst").alias("e")).groupBy("pack").agg(F.array_sort(F.collect_list(F.struct("pos", "e"))).alias("links"))
    rows = R.predictions(spark, sf_dir).join(known_anchors(spark, sf_dir).select("sample_key", "ids"), "sample_key").join(links, "pack", "left")
    edges = F.coalesce(F.transform("links", lambda x: x["e"]), F.array().cast("array<array<string>>"))
    return rows.select("pred_id", F.posexplode(G.chain_candidates(F.col("chain"), F.col("ids"), edges)).alias("place", "c")).select("pred_id", "place", G.joined("c").alias("chain"))


@query(
    base(
        """SELECT arm, track, count(*) AS steps, count(e.src) AS supported, round(count(e.src) / count(*), 4) AS share
        FROM (SELECT pack, arm, track, chain, unnest(range(1, len(chain))) AS i FROM preds1 WHERE len(chain) > 1) AS p LEFT JOIN pairs1 AS e ON e.pack = p.pack AND e.src = p.chain[p.i] AND e.dst = p.chain[p.i + 1] GROUP BY arm, track"""
    )
)
def edge_support_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the predicted chains' steps that the given graph has, by arm and track."""
    rows = R.predictions(spark, sf_dir).where(F.size("chain") > 1).select("pack", "arm", "track", F.explode(T.steps(F.col("chain"))).alias("step"))
    known = R.pair_levels(spark, sf_dir).select("pack", F.concat_ws(">", "src", "dst").alias("step"), F.lit(1).alias("there"))
    return rows.join(known, ["pack", "step"], "left").groupBy("arm", "track").agg(F.count(F.lit(1)).alias("steps"), F.count("there").alias("supported"), F.round(F.count("there") / F.count(F.lit(1)), 4).alias("share"))


@query(
    base(
        """SELECT e.pack, e.src AS event_id, min(e.dst) AS first_successor, count(DISTINCT e.dst) AS successors, count(DISTINCT g.sample_key) AS gold_pairs FROM edges1 AS e
        LEFT JOIN (SELECT DISTINCT g.sample_key, g.pack, c[1] AS src, c[2] AS dst FROM (SELECT sample_key, pack, unnest(chains) AS c FROM gold1) AS g WHERE len(c) = 2) AS g ON g.pack = e.pack AND g.src = e.src AND g.dst = e.dst GROUP BY e.pack, e.src"""
    )
)
def direct_successors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and number of direct successors of each event, and the gold chains that are such a pair."""
    pairs = R.gold(spark, sf_dir).select("sample_key", "pack", F.explode("chains").alias("c")).where(F.size("c") == 2).select("sample_key", "pack", F.col("c")[0].alias("src"), F.col("c")[1].alias("dst")).distinct()
    return R.edges(spark, sf_dir).join(pairs, ["pack", "src", "dst"], "left").groupBy("pack", F.col("src").alias("event_id")).agg(F.min("dst").alias("first_successor"), F.countDistinct("dst").alias("successors"), F.countDistinct("sample_key").alias("gold_pairs"))


@query(
    base(
        """SELECT pack, min(other) AS group_pack FROM (SELECT pack, other FROM reach UNION SELECT pack, pack FROM links1) GROUP BY pack HAVING count(DISTINCT other) > 1""",
        r"""links1 AS (SELECT DISTINCT pack, lower(regexp_replace(text, '\s+', '', 'g')) AS entity FROM documents WHERE pack IS NOT NULL AND regexp_replace(text, '\s+', '', 'g') <> ''),
        tied AS (SELECT DISTINCT a.pack, b.pack AS other FROM links1 AS a JOIN links1 AS b USING (entity)),
        reach AS (SELECT pack, other FROM tied UNION SELECT r.pack, t.other FROM reach AS r JOIN tied AS t ON t.pack = r.other)""",
    )
)
def components_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs that share a text, layout and case apart, directly or through others, with the smallest pack of their group."""
    docs = table(spark, sf_dir, "documents").where("pack IS NOT NULL").select(F.col("pack").alias("record"), T.squeezed(F.col("text")).alias("t")).where("t <> ''")
    links = cut_lineage(docs.select("record", F.unhex(F.sha2("t", 256)).alias("entity")).distinct())
    shared = links.groupBy("entity").agg(F.min("record").alias("lo"), F.max("record").alias("hi")).where("lo <> hi").select("entity")
    return propagate(links.join(shared, "entity", "left_semi")).select(F.col("record").alias("pack"), F.col("label").alias("group_pack"))


@query(
    base(
        f"""SELECT sample_key, path FROM (SELECT *, row_number() OVER (PARTITION BY sample_key ORDER BY rule, a DESC, b DESC, c DESC, path) AS n FROM (
        SELECT t.sample_key, 1 AS rule, r.relevance AS a, 0.0 AS b, 0.0 AS c, e.src || '>' || t.target AS path FROM t1 AS t JOIN edges1 AS e ON e.pack = t.pack AND e.dst = t.target JOIN ranked AS r ON r.sample_key = t.sample_key AND r.event_id = e.src WHERE contains(question, '直接原因')
        UNION ALL SELECT t.sample_key, 2, r.relevance, 0.0, 0.0, t.target || '>' || e.dst FROM t1 AS t JOIN edges1 AS e ON e.pack = t.pack AND e.src = t.target JOIN ranked AS r ON r.sample_key = t.sample_key AND r.event_id = e.dst WHERE regexp_matches(question, '后续|影响|引发')
        UNION ALL SELECT sample_key, 3, n, strength, mean, path FROM tp WHERE first <> target AND list_contains(p, first)
        UNION ALL SELECT sample_key, 4, n, strength, mean, path FROM tp WHERE regexp_matches(question, '自起点|一步步|完整|多跳|依次')
        UNION ALL SELECT sample_key, 5, mean, -n, 0.0, path FROM tp
        UNION ALL SELECT k.sample_key, 6, r.relevance, 0.0, 0.0, e.src || '>' || k.event_id FROM rank1 AS k SEMI JOIN edges0 AS z ON z.pack = k.pack JOIN edges1 AS e ON e.pack = k.pack AND e.dst = k.event_id JOIN ranked AS r ON r.sample_key = k.sample_key AND r.event_id = e.src WHERE k.rnk = 1
        UNION ALL SELECT k.sample_key, 7, r.relevance, 0.0, 0.0, k.event_id || '>' || e.dst FROM rank1 AS k JOIN edges1 AS e ON e.pack = k.pack AND e.src = k.event_id JOIN ranked AS r ON r.sample_key = k.sample_key AND r.event_id = e.dst WHERE k.rnk = 1
        UNION ALL SELECT sample_key, 8, 0.0, 0.0, 0.0, target FROM target1
        UNION ALL SELECT sample_key, 9, 0.0, 0.0, 0.0, event_id FROM rank1 WHERE rnk = 1)) WHERE n = 1""",
        _ROOTS
        + f""", t1 AS (SELECT t.sample_key, t.pack, t.target, k.ids[1] AS first, q.question FROM target1 AS t JOIN known1 AS k USING (sample_key) JOIN questions1 AS q USING (sample_key)),
        tp AS (SELECT t.sample_key, t.question, t.target, t.first, p.path AS p, array_to_string(p.path, '>') AS path, len(p.path)::DOUBLE AS n, coalesce(s.strength, 0.0) AS strength, m.mean FROM t1 AS t JOIN paths1 AS p ON p.pack = t.pack AND p.path[-1] = t.target AND len(p.path) <= 12
          SEMI JOIN roots1 AS r ON r.pack = p.pack AND r.event_id = p.path[1] SEMI JOIN edges0 AS z ON z.pack = t.pack
          LEFT JOIN (SELECT pack, path, round(sum(w), 6) AS strength FROM (SELECT p.pack, p.path, {_WEIGHT}::DOUBLE AS w FROM (SELECT pack, path, unnest(range(1, len(path))) AS i FROM paths1) AS p JOIN pairs1 AS e ON e.pack = p.pack AND e.src = p.path[p.i] AND e.dst = p.path[p.i + 1]) GROUP BY ALL) AS s ON s.pack = p.pack AND s.path = p.path
          JOIN (SELECT q.sample_key, p.path, round(avg(coalesce(r.relevance, 0.0)), 6) AS mean FROM questions1 AS q JOIN (SELECT pack, path, unnest(path) AS event_id FROM paths1) AS p ON p.pack = q.pack LEFT JOIN ranked AS r ON r.sample_key = q.sample_key AND r.event_id = p.event_id GROUP BY ALL) AS m ON m.sample_key = t.sample_key AND m.path = p.path)""",
    )
)
def selected_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain a graph baseline answers each question with.

    Rules in order: a direct cause; a follow-up; a path from the first named event to the last; a whole path to the last; the
    most relevant path to it; a neighbour of the best candidate; a single event. Ties go by the path.
    """
    rel = unbroadcast(cut_lineage(ranked_candidates(spark, sf_dir)))
    relevance = rel.select("sample_key", "event_id", "relevance")
    e = R.edges(spark, sf_dir).select("pack", "src", "dst").distinct()
    with_edges = R.raw_edges(spark, sf_dir).select("pack").distinct()
    known = known_anchors(spark, sf_dir).where(F.size("ids") > 0).select("sample_key", "pack", "ids", F.element_at("ids", -1).alias("target"))
    t = known.join(R.questions(spark, sf_dir).select("sample_key", "question"), "sample_key")
    zero = F.lit(0.0)

    def rule(df: DataFrame, n: int, path, a=zero, b=zero, c=zero) -> DataFrame:
        return df.select("sample_key", F.lit(n).alias("rule"), a.cast("double").alias("a"), b.cast("double").alias("b"), c.cast("double").alias("c"), path.alias("path"))

    def neighbour(df: DataFrame, own: str, other: str, at: str) -> DataFrame:
        return df.join(e.select("pack", F.col(own).alias(at), F.col(other).alias("event_id")), ["pack", at]).join(relevance, ["sample_key", "event_id"])

    direct = [
        rule(neighbour(t.where(F.contains("question", F.lit("直接原因"))), "dst", "src", "target"), 1, F.concat_ws(">", "event_id", "target"), F.col("relevance")),
        rule(neighbour(t.where(F.col("question").rlike("后续|影响|引发")), "src", "dst", "target"), 2, F.concat_ws(">", "target", "event_id"), F.col("relevance")),
    ]
    direct = cut_lineage(direct[0].unionByName(direct[1]))
    # Paths are walked only in packs of questions that the first rules leave open.
    wanted = unbroadcast(cut_lineage(t.join(unbroadcast(direct), "sample_key", "left_anti").join(with_edges, "pack", "left_semi")))
    some = wanted.select("pack").distinct()
    d = G.degrees(spark, sf_dir).withColumn("free", F.sum((F.col("indegree") == 0).cast("int")).over(Window.partitionBy("pack")))
    roots = d.where("indegree = 0 OR free = 0").select("pack", "event_id").join(some, "pack", "left_semi")
    rooted = G.path_strength(G.simple_paths(roots, e.join(some, "pack", "left_semi"), G.MOST_NODES), R.pair_levels(spark, sf_dir), True).withColumn("target", F.element_at("path", -1))
    tp = wanted.join(G.relevance_map(relevance), "sample_key", "left").join(rooted, ["pack", "target"])
    text, first, n = G.joined("path"), F.element_at("ids", 1), F.size("path")
    number = F.when((first != F.col("target")) & F.array_contains("path", first), 3).when(F.col("question").rlike("自起点|一步步|完整|多跳|依次"), 4).otherwise(5)
    # A question's rows of the first rule that any of its paths meets go before the others, so each path counts for its own first rule.
    tp = tp.withColumn("mean", G.mean_relevance()).select("sample_key", number.alias("rule"), F.when(number < 5, n).otherwise(F.col("mean")).cast("double").alias("a"), F.when(number < 5, F.col("strength")).otherwise(-n).cast("double").alias("b"), F.when(number < 5, F.col("mean")).otherwise(zero).alias("c"), text.alias("path"))
    parts = [direct, tp]
    top = rel.where("rnk = 1").select("sample_key", "pack", F.col("event_id").alias("top"))
    parts += [
        rule(neighbour(top, "dst", "src", "top"), 6, F.concat_ws(">", "event_id", "top"), F.col("relevance")),
        rule(neighbour(top, "src", "dst", "top"), 7, F.concat_ws(">", "top", "event_id"), F.col("relevance")),
        rule(known, 8, F.col("target")),
        rule(top, 9, F.col("top")),
    ]
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    best = F.min(F.struct("rule", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"), (-F.col("c")).alias("c"), "path"))
    return every.groupBy("sample_key").agg(best.alias("best")).select("sample_key", "best.path")
