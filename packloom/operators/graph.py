"""Directed causal graphs of packs: paths, scores, diversity and chains."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.functions import text as T
from packloom.operators.retrieval import bm25, hot_packs, known_anchors, ranked_candidates
from packloom.session import cut_lineage
from packloom.sources import relations as R
from packloom.sources.tables import unbroadcast

#: Nodes of the longest path of a search from the roots, and paths of a pack beyond which enumeration fails rather than leaving some out.
MOST_NODES, MOST_PATHS = 12, 100_000
#: First characters of arguments and document that count in the scores of the queries whose SQL says so.
MOST_CHARS = 400


def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pack, event_id, indegree, outdegree)``, double edges counted; events without edges have zeros."""
    e = R.edges(spark, sf_dir)
    ends = e.select("pack", F.explode(F.array(F.struct(F.col("src").alias("event_id"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col("dst").alias("event_id"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("x"))
    n = ends.groupBy("pack", "x.event_id").agg(F.sum("x.i").alias("indegree"), F.sum("x.o").alias("outdegree"))
    return R.events(spark, sf_dir).select("pack", "event_id").join(n, ["pack", "event_id"], "left").na.fill(0, ["indegree", "outdegree"])


def simple_paths(nodes: DataFrame, edges: DataFrame, most_nodes: int | None = None, most_paths: int = MOST_PATHS) -> DataFrame:
    """``(pack, path)``: every single event and every directed path without repeats; with ``most_nodes``, those of at most so many events.

    ``nodes(pack, event_id)``, ``edges(pack, src, dst)``. Each pack is one row with its events and different edges, and its paths
    are walked in one pass over such rows, so two shuffles of edges do whatever the length. A pack of more than ``most_paths``
    paths raises an error, before its edges are gathered if they alone are more; nothing is left out silently.
    """
    links, starts = edges.select("pack", "src", "dst").distinct(), nodes.select("pack", "event_id").distinct()
    gathered = starts.groupBy("pack").agg(F.count(F.lit(1)).alias("n"), F.collect_list("event_id").alias("starts"))
    if (over := links.groupBy("pack").count().where(F.col("count") > most_paths).limit(5).collect()):
        raise ValueError(f"more than {most_paths} paths in packs {[r['pack'] for r in over]}")
    linked = links.groupBy("pack").agg(F.collect_list(F.struct("src", "dst")).alias("links"))
    rows = unbroadcast(gathered).join(unbroadcast(linked), "pack", "left").select("pack", "starts", F.coalesce("links", F.array().cast("array<struct<src:string,dst:string>>")).alias("links"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for pack, begins, steps in zip(*(c.to_pylist() for c in b.columns), strict=True):
                after: dict[str, list[str]] = {}
                for x in steps:
                    after.setdefault(x["src"], []).append(x["dst"])
                found: list[list[str] | None] = []
                open_ = [[x] for x in begins]
                while open_ and len(found) <= most_paths:
                    path = open_.pop()
                    found.append(path)
                    if most_nodes is None or len(path) < most_nodes:
                        open_ += [[*path, x] for x in after.get(path[-1], ()) if x not in path]
                if len(found) > most_paths:
                    found = [None]  # the mark of a pack that goes beyond the bound
                yield pa.record_batch([pa.array([pack] * len(found)), pa.array(found, pa.list_(pa.string()))], names=["pack", "path"])

    out = unbroadcast(cut_lineage(rows.mapInArrow(walk, "pack string, path array<string>")))
    if (over := out.where("path IS NULL").limit(5).collect()):
        raise ValueError(f"more than {most_paths} paths in packs {[r['pack'] for r in over]}")
    return out


def pack_paths(spark: SparkSession, sf_dir: str, most_nodes: int | None = None) -> DataFrame:
    """All simple paths of all packs with events; with ``most_nodes``, those of at most so many events."""
    return simple_paths(R.events(spark, sf_dir), R.edges(spark, sf_dir), most_nodes)


def path_hints(spark: SparkSession, sf_dir: str, limit: int = 3) -> DataFrame:
    """``(sample_key, path, rnk)``: the best maximal paths of each question's pack.

    A maximal path begins at a candidate without edges into it (any, where all have some) and ends at one without edges out of it or at the
    ``MOST_NODES``-th. Those that cover more of the named candidates go first, then the mean relevance, then the longer; ties go by the path.
    Packs without edge rows have none.
    """
    e, ids = R.edges(spark, sf_dir).select("pack", "src", "dst").distinct(), R.candidates(spark, sf_dir).select("pack", "event_id").distinct()
    nodes = ids.join(R.raw_edges(spark, sf_dir).select("pack").distinct(), "pack", "left_semi")
    ends = nodes.join(e.select("pack", F.col("dst").alias("event_id"), F.lit(True).alias("fed")).distinct(), ["pack", "event_id"], "left").join(e.select("pack", F.col("src").alias("event_id"), F.lit(True).alias("feeds")).distinct(), ["pack", "event_id"], "left")
    ends = unbroadcast(cut_lineage(ends.withColumn("free", F.count_if(F.col("fed").isNull()).over(Window.partitionBy("pack")))))
    roots, sinks = ends.where("fed IS NULL OR free = 0"), ends.where("feeds IS NULL").select("pack", F.col("event_id").alias("end"), F.lit(True).alias("sink"))
    paths = simple_paths(roots, e, MOST_NODES).withColumn("end", F.element_at("path", -1)).join(sinks, ["pack", "end"], "left").where((F.size("path") >= MOST_NODES) | F.col("sink"))
    asked = known_anchors(spark, sf_dir).select("sample_key", "pack", "ids").join(relevance_map(ranked_candidates(spark, sf_dir)), "sample_key", "left")
    rows = asked.join(paths.select("pack", "path"), "pack").withColumn("mean", mean_relevance())
    cover = F.round(F.size(F.array_intersect("ids", "path")) / F.greatest(F.lit(1), F.size("ids")), 6)
    order = Window.partitionBy("sample_key").orderBy(F.desc(cover), F.desc("mean"), F.desc(F.size("path")), joined("path"))
    return rows.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= limit).select("sample_key", joined("path").alias("path"), "rnk")


def joined(path: Column | str) -> Column:
    """A path as text; orders as the path does for ids of one width."""
    return F.array_join(path, ">")


def strength(level: Column) -> Column:
    """Weight of an edge's level."""
    return F.when(level == "certain", 1.0).when(level == "probable", 0.7).when(level == "possible", 0.4).otherwise(0.7)


def path_strength(paths: DataFrame, levels: DataFrame, single: bool = False) -> DataFrame:
    """``(pack, path, strength)``: summed weights of a path's steps; a step without an edge weighs 0.5. ``levels(pack, src, dst, level)``.

    Paths of one event are left out, or with ``single`` have no strength, 0.

    A pack's weights meet its paths as one map, so paths are neither taken apart nor put together again.
    """
    known = levels.groupBy("pack").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws(">", "src", "dst"), strength(F.col("level"))))).alias("weights"))
    total = F.aggregate(T.steps(F.col("path")), F.lit(0.0), lambda acc, s: acc + F.coalesce(F.try_element_at("weights", s), F.lit(0.5)))
    return unbroadcast(paths.where(F.lit(single) | (F.size("path") > 1)).join(known, "pack", "left")).select("pack", "path", F.round(total, 6).alias("strength"))


def relevance_map(relevance: DataFrame) -> DataFrame:
    """``(sample_key, rel)``: one map a question from the events of its pack to their relevance. ``relevance(sample_key, event_id, relevance)``."""
    return unbroadcast(relevance).groupBy("sample_key").agg(F.map_from_entries(F.collect_list(F.struct("event_id", "relevance"))).alias("rel"))


def _relevance_of(event: Column) -> Column:
    return F.coalesce(F.try_element_at("rel", event), F.lit(0.0))


def mean_relevance() -> Column:
    """Mean relevance of the events of ``path`` by the map ``rel``; an event without one counts 0."""
    return F.round(F.aggregate("path", F.lit(0.0), lambda acc, x: acc + _relevance_of(x)) / F.size("path"), 6)


def question_paths(spark: SparkSession, sf_dir: str, relevance: DataFrame, most_nodes: int | None = None) -> DataFrame:
    """``(sample_key, pack, path, mean, first, last, best)``: each question's pack's paths with their nodes' relevance.

    ``relevance(sample_key, event_id, relevance)``; a node without one counts 0.
    """
    asked = R.questions(spark, sf_dir).select("sample_key", "pack").join(relevance_map(relevance), "sample_key", "left")
    rows = asked.join(pack_paths(spark, sf_dir, most_nodes), "pack")
    best = F.aggregate("path", F.lit(0.0), lambda acc, x: F.greatest(acc, _relevance_of(x)))
    return rows.select("sample_key", "pack", "path", mean_relevance().alias("mean"), _relevance_of(F.element_at("path", 1)).alias("first"), _relevance_of(F.element_at("path", -1)).alias("last"), best.alias("best"))


def conditioned_paths(spark: SparkSession, sf_dir: str, limit: int = 5) -> DataFrame:
    """``(sample_key, path, rnk)``: a question's best path segments of two to ten events, by intent.

    Segments that match what is asked go first, then those that cover more of the named events, then the mean relevance, then the
    shorter (the longer, if a whole chain is asked for); ties go by the path.
    """
    rel = ranked_candidates(spark, sf_dir).select("sample_key", "event_id", "relevance")
    q = R.questions(spark, sf_dir).select("sample_key", "question", "kind").join(known_anchors(spark, sf_dir).select("sample_key", "ids"), "sample_key")
    rows = question_paths(spark, sf_dir, rel, 10).where(F.size("path") >= 2).join(q, "sample_key")
    intent = T.question_intent(F.col("question"), F.col("kind"), F.col("ids"))
    begin, end, n = F.element_at("path", 1), F.element_at("path", -1), F.size("path")
    one, other = F.try_element_at("ids", F.lit(1)), F.try_element_at("ids", F.lit(-1))
    match = (
        F.when(intent == "direct_down", (begin == one) & (n == 2))
        .when(intent == "direct_up", (end == one) & (n == 2))
        .when(intent == "from_to", (begin == one) & (end == other))
        .when(intent == "future", (begin == other) & ~F.array_contains("ids", end))
        .when(intent == "upstream", end == one)
        .otherwise(F.lit(False))
    )
    cover = F.round(F.size(F.array_intersect("ids", "path")) / F.greatest(F.lit(1), F.size("ids")), 6)
    longer = F.when(F.col("question").rlike("完整|多跳|连锁|传导"), n).otherwise(-n)
    order = Window.partitionBy("sample_key").orderBy(F.desc(match.cast("int")), F.desc(cover), F.desc("mean"), F.desc(longer), joined("path"))
    return rows.withColumn("rnk", F.row_number().over(order)).where(F.col("rnk") <= limit).select("sample_key", joined("path").alias("path"), "rnk")


def semantic_relevance(spark: SparkSession, sf_dir: str, most: int | None = MOST_CHARS) -> DataFrame:
    """``(sample_key, event_id, relevance)``: BM25 of the question without its ids against the events' own words, over its maximum.

    Of an event's arguments and document the first ``most`` characters count, or all with None.
    """
    docs, ev = R.documents(spark, sf_dir).withColumnRenamed("doc_code", "doc_id"), R.events(spark, sf_dir)
    begin = lambda c: c if most is None else F.substring(c, 1, most)
    arguments = F.coalesce(F.array_join(F.map_values("argument"), "；"), F.lit(""))
    text = F.concat_ws(" ", F.coalesce("event_type", F.lit("")), F.coalesce("trigger_word", F.lit("")), begin(arguments), begin(F.coalesce("text", F.lit(""))))
    texts = ev.join(docs, ["pack", "doc_id"], "left").select(F.col("pack").alias("corpus"), F.col("event_id").alias("item"), text.alias("text"))
    asked = R.questions(spark, sf_dir).select(F.col("sample_key").alias("query"), F.col("pack").alias("corpus"), F.regexp_replace("question", "D[0-9]{3,}", " ").alias("text"))
    scores = bm25(asked, texts, hot_packs(spark, sf_dir))
    best = F.max("score").over(Window.partitionBy("query"))
    return scores.select(F.col("query").alias("sample_key"), F.col("item").alias("event_id"), F.round(F.col("score") / best, 6).alias("relevance"))


def scored_paths(spark: SparkSession, sf_dir: str, most: int | None = MOST_CHARS) -> DataFrame:
    """``(sample_key, pack, path, score)``: roles, anchors, relevance (``most`` as there) and length of every path, added up."""
    q = R.questions(spark, sf_dir).select("sample_key", "question").join(known_anchors(spark, sf_dir).select("sample_key", "ids"), "sample_key")
    rows = question_paths(spark, sf_dir, semantic_relevance(spark, sf_dir, most)).join(q, "sample_key")
    question, ids, n = F.col("question"), F.col("ids"), F.size("path")
    zero = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    roles = 1.5 * zero(T.role(question, ids, "start") == F.element_at("path", 1)) + 1.5 * zero(T.role(question, ids, "end") == F.element_at("path", -1))
    anchor = F.when(F.size(ids).between(1, 2), 0.6 * F.size(F.array_intersect("ids", "path")) / F.size(ids)).otherwise(0.0)
    semantic = 0.45 * F.col("first") + 0.45 * F.col("last") + 0.10 * F.col("best")
    length = F.when(question.rlike(T.DIRECT), F.when(n == 2, 0.3).otherwise(0.0)).when(question.rlike(T.PROCESS), 0.08 * F.least(n - 1, F.lit(6))).otherwise(-0.03 * (n - 1))
    return rows.select("sample_key", "pack", "path", F.round(roles + anchor + semantic + length, 8).alias("score"))


def diverse_paths(scored: DataFrame, limit: int = 5, penalty: float = 0.25) -> DataFrame:
    """``(sample_key, path, rnk)``: greedy choice by score less ``penalty`` times the greatest overlap (Jaccard) with a chosen path.

    Ties go to the shorter, then to the lexicographically larger path. A sample's paths form one group; their number is bounded
    by the enumeration's own cap.
    """

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        paths = [tuple(p) for p in pdf["path"]]
        sets = [frozenset(p) for p in paths]
        score, worst = pdf["score"].tolist(), [0.0] * len(paths)
        left, out = set(range(len(paths))), []
        while left and len(out) < limit:
            i = max(left, key=lambda k: (round(score[k] - penalty * worst[k], 9), -len(paths[k]), paths[k]))
            left.remove(i)
            out.append(i)
            for k in left:
                worst[k] = max(worst[k], len(sets[k] & sets[i]) / len(sets[k] | sets[i]))
        return pd.DataFrame({"sample_key": pdf["sample_key"].iloc[0], "path": [">".join(paths[i]) for i in out], "rnk": range(1, len(out) + 1)})

    return scored.select("sample_key", "path", "score").groupBy("sample_key").applyInPandas(choose, "sample_key string, path string, rnk int")


def targeted_paths(spark: SparkSession, sf_dir: str, limit: int = 5) -> DataFrame:
    """``(sample_key, path, rnk)``: what a narrow intent clearly asks for goes first, the rest keeps the diverse order; whole texts count."""
    scored = unbroadcast(cut_lineage(scored_paths(spark, sf_dir, None)))
    q = R.questions(spark, sf_dir).select("sample_key", "question", "kind").join(known_anchors(spark, sf_dir).select("sample_key", "ids"), "sample_key")
    asked = q.select("sample_key", "ids", T.targeted_intent(F.col("question"), F.col("kind"), F.col("ids")).alias("intent")).where("intent IS NOT NULL")
    direct = R.pair_levels(spark, sf_dir).where("causal_type LIKE '%直接%'").select("pack", F.array("src", "dst").alias("path"), F.lit(True).alias("direct"))
    rows = scored.join(asked, "sample_key").join(direct, ["pack", "path"], "left")
    one, n = F.element_at("ids", 1), F.size("path")
    wanted = (
        F.when(F.col("intent") == "temporal_causal_pair", F.col("path") == F.col("ids"))
        .when(F.col("intent") == "direct_effect", F.coalesce("direct", F.lit(False)) & (F.element_at("path", 1) == one))
        .when(F.col("intent") == "unspecified_direct", F.coalesce("direct", F.lit(False)) & F.array_contains("path", one))
        .otherwise((n == 1) & (F.element_at("path", 1) == one))
    )
    first = rows.where(wanted).select("sample_key", joined("path").alias("path"), F.row_number().over(Window.partitionBy("sample_key").orderBy(F.desc("score"), joined("path"))).alias("rnk"), F.lit(0).alias("part"))
    rest = diverse_paths(scored, 2 * limit).withColumn("part", F.lit(1))
    both = first.unionByName(rest).groupBy("sample_key", "path").agg(F.min(F.struct("part", "rnk")).alias("at"))
    place = F.row_number().over(Window.partitionBy("sample_key").orderBy("at"))
    return both.withColumn("rnk", place).where(F.col("rnk") <= limit).select("sample_key", "path", "rnk")


def contiguous_trims(chain: Column) -> Column:
    """All parts of a chain in one piece, the whole left out, from the left and longest first."""
    n = F.size(chain)
    lefts = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    per = F.transform(lefts, lambda left: F.transform(F.sequence(n, left + 1), lambda right: F.slice(chain, left + 1, right - left)))
    return F.filter(F.flatten(per), lambda c: F.size(c) < n)


def ordered_skips(chain: Column) -> Column:
    """Parts of two or more events of a chain of three to seven that keep the order but leave out some inside; longest first."""
    n = F.size(chain)
    masks = F.when(n.between(3, 7), F.sequence(F.lit(1), F.shiftleft(F.lit(1), 7) - 1)).otherwise(F.array().cast("array<int>"))
    masks = F.filter(masks, lambda m: m < F.pow(F.lit(2), n))
    places = F.transform(masks, lambda m: F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.floor(m / F.pow(F.lit(2), i)) % 2 == 1))
    gaps = F.filter(places, lambda p: (F.size(p) >= 2) & (F.size(p) < n) & (F.element_at(p, -1) - p[0] + 1 > F.size(p)))
    longest = F.transform(F.array_sort(F.transform(gaps, lambda p: F.struct((-F.size(p)).alias("size"), p.alias("p")))), lambda s: s["p"])
    return F.transform(longest, lambda p: F.transform(p, lambda i: F.get(chain, i.cast("int"))))


def chain_candidates(chain: Column, anchors: Column, links: Column, limit: int = 16) -> Column:
    """Chains to check beside a drafted one: the draft, its trims and skips, single anchors and given edges at an anchor.

    ``links`` are two-event arrays. Without repeats, keeping the first of equal ones, ``limit`` at most (the feature's own bound).
    """
    single = F.transform(anchors, lambda a: F.array(a))
    touching = F.filter(links, lambda e: F.arrays_overlap(e, anchors))
    every = F.concat(F.array(chain), contiguous_trims(chain), ordered_skips(chain), single, touching)
    proper = F.filter(every, lambda c: (F.size(c) > 0) & (F.size(F.array_distinct(c)) == F.size(c)))
    return F.slice(F.array_distinct(proper), 1, limit)
