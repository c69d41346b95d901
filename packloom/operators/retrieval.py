"""Lexical and vector retrieval inside packs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.functions import text as T
from packloom.operators.skew import hot_keys, salted_join
from packloom.session import cut_lineage
from packloom.sources import relations as R
from packloom.sources.tables import table, unbroadcast

K1, B = 1.2, 0.75
#: Texts whose terms are counted at once.
PIECE = 500


_TOKEN = re.compile(T.TOKEN.replace("\\x{4e00}", "\u4e00").replace("\\x{9fff}", "\u9fff"))


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of tokens of each (lower-case) text, as ``text.tokens`` has them, and counts of those that are wanted."""
    shape = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    last, wanted = None, frozenset()
    # Counts of a whole batch of long texts would be hundreds of megabytes of Python objects.
    for b in (b.slice(i, PIECE) for b in batches for i in range(0, b.num_rows, PIECE)):
        lengths, terms = [], []
        for text, asked in zip(b.column(2).to_pylist(), b.column(3), strict=True):
            raw = _TOKEN.findall(text) if text else []
            pairs = [x + y for x, y in zip(raw, raw[1:]) if len(x) == 1 == len(y)]
            if asked != last:
                last, wanted = asked, frozenset(asked.as_py())
            n = Counter(raw)
            n.update(pairs)
            lengths.append(len(raw) + len(pairs))
            terms.append([{"term": t, "tf": n[t]} for t in n.keys() & wanted])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(lengths, pa.int32()), pa.array(terms, shape)], names=[b.schema.names[0], b.schema.names[1], "length", "terms"])


def bm25(queries: DataFrame, texts: DataFrame, hot: list | None = None) -> DataFrame:
    """BM25 of each query against the texts of its own corpus: ``(query, corpus, item, score)``.

    ``queries(query, corpus, text)``, ``texts(corpus, item, text)``. Statistics are those of the corpus alone; a query's
    terms are a set; lengths count all tokens, pairs too. Items that share no term with the query give no row (their score
    is zero); null texts count as empty. Texts meet the different terms that their corpus is asked for, are tokenised once in that row, and
    only the counts of such terms go on; rows of hot corpora (``hot``, counted here if None) are split. Nothing is broadcast.
    """
    asked = unbroadcast(queries).select("query", "corpus", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
    wanted = asked.groupBy("corpus").agg(F.collect_set("term").alias("wanted"))
    met = salted_join(texts.select("corpus", "item", "text"), wanted, "corpus", ["item"], "inner", hot)

    # Counting in the JVM would compare each wanted term with each token by interpreted lambdas; one hash count a text does it over Arrow batches.
    told = met.select("corpus", "item", F.lower("text").alias("text"), "wanted")
    counted = unbroadcast(cut_lineage(told.mapInArrow(_term_counts, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in told.schema.fields[:2])}, length int, terms array<struct<term:string,tf:int>>")))
    stats = counted.groupBy("corpus").agg(F.count(F.lit(1)).alias("n"), F.when(F.sum("length") == 0, F.lit(1.0)).otherwise(F.avg("length")).alias("mean"))
    tf = counted.select("corpus", "item", "length", F.inline("terms"))
    df = tf.groupBy("corpus", "term").agg(F.count(F.lit(1)).alias("df"))
    weighted = tf.join(df, ["corpus", "term"]).join(stats, "corpus")
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    parts = weighted.select("corpus", "term", "item", part.alias("part"))
    return asked.join(parts, ["corpus", "term"]).groupBy("query", "corpus", "item").agg(F.sum("part").alias("score"))


def hot_packs(spark: SparkSession, sf_dir: str) -> list:
    """Packs with a large share of the events and documents, told from the key columns alone."""
    return hot_keys(table(spark, sf_dir, "case_events").select("pack").unionByName(table(spark, sf_dir, "documents").select("pack")), "pack")


def ranked_candidates(spark: SparkSession, sf_dir: str, weight: float = 1.0, semantic: DataFrame | None = None) -> DataFrame:
    """``(sample_key, pack, ord, event_id, score, relevance, rnk)`` for each question and candidate of its pack.

    Relevance is the score over the question's maximum (0 where that is 0). With ``semantic(sample_key, event_id, cosine)`` it is
    ``weight`` times that plus the rest times the cosine, where positive. Ties keep the candidates' order.
    """
    q, c = R.questions(spark, sf_dir), R.candidates(spark, sf_dir)
    scores = bm25(q.select(F.col("sample_key").alias("query"), F.col("pack").alias("corpus"), F.col("question").alias("text")), c.select(F.col("pack").alias("corpus"), F.struct("ord", "event_id").alias("item"), "text"), hot_packs(spark, sf_dir))
    scores = scores.select(F.col("query").alias("sample_key"), "item.ord", "item.event_id", "score")
    every = q.select("sample_key", "pack").join(c.select("pack", "ord", "event_id"), "pack").join(scores, ["sample_key", "ord", "event_id"], "left")
    best = F.max("score").over(Window.partitionBy("sample_key"))
    out = every.select("sample_key", "pack", "ord", "event_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.round(F.coalesce(F.col("score") / F.nullif(best, F.lit(0.0)), F.lit(0.0)), 6).alias("relevance"))
    if semantic is not None:
        out = out.join(semantic, ["sample_key", "event_id"], "left").withColumn("relevance", F.round(weight * F.col("relevance") + (1 - weight) * F.greatest(F.lit(0.0), F.coalesce("cosine", F.lit(0.0))), 8)).drop("cosine")
    return out.withColumn("rnk", F.row_number().over(Window.partitionBy("sample_key").orderBy(F.desc("relevance"), "ord", "event_id")))


def known_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_key, ids)``: event ids a question names that its pack has, in order of first mention."""
    known = R.candidates(spark, sf_dir).groupBy("pack").agg(F.collect_set("event_id").alias("known"))
    q = unbroadcast(R.questions(spark, sf_dir).join(known, "pack", "left"))
    return q.select("sample_key", "pack", F.filter(T.event_ids(F.col("question")), lambda x: F.array_contains(F.coalesce("known", F.array().cast("array<string>")), x)).alias("ids"))


def sentence_scores(terms: Column, toks: Column) -> Column:
    """BM25 of a query's terms against the sentences of one text, a score for each; the text's sentences are the corpus.

    All inside the row: a text's sentences are there already, so nothing is shuffled.
    """

    def scored(x: Column) -> Column:
        n, total = F.size(x["s"]), F.aggregate(x["s"], F.lit(0), lambda a, t: a + F.size(t))
        mean = F.when(total == 0, F.lit(1.0)).otherwise(total / n)
        held = F.transform(x["q"], lambda q: F.struct(q.alias("q"), F.size(F.filter(x["s"], lambda t: F.array_contains(t, q))).alias("df")))
        known = F.filter(held, lambda h: h["df"] > 0)

        def of(t: Column, k: Column, average: Column) -> Column:
            def add(acc: Column, h: Column) -> Column:
                tf = F.size(F.filter(t, lambda y: y == h["q"]))
                idf = F.log(1 + (n - h["df"] + 0.5) / (h["df"] + 0.5))
                return F.when(F.array_contains(t, h["q"]), acc + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.size(t) / average))).otherwise(acc)

            return F.aggregate(k, F.lit(0.0), add)

        return T.let(F.struct(known.alias("k"), mean.alias("m")), lambda y: F.transform(x["s"], lambda t: of(t, y["k"], y["m"])))

    return T.let(F.struct(terms.alias("q"), toks.alias("s")), scored)


def best_excerpts(spark: SparkSession, sf_dir: str, asked: DataFrame, most: int = 240) -> DataFrame:
    """``(sample_key, event_id, excerpt)``: the sentence of the event's document that suits question and label best.

    ``asked(sample_key, pack, event_id)``. Sentences are scored against each other by BM25; the first of the best is cut to
    ``most`` characters. A document without sentences gives the empty text.
    """
    q = R.questions(spark, sf_dir).select("sample_key", "question")
    c = R.candidates(spark, sf_dir).select("pack", "event_id", "doc_id", "label")
    docs = R.documents(spark, sf_dir).select("pack", F.col("doc_code").alias("doc_id"), T.sentences(F.col("text")).alias("parts"))
    docs = docs.withColumn("toks", F.transform("parts", T.tokens))
    rows = asked.join(c, ["pack", "event_id"]).join(q, "sample_key").join(docs, ["pack", "doc_id"], "left")
    scores = sentence_scores(F.array_distinct(T.tokens(F.concat_ws(" ", "question", "label"))), F.col("toks"))
    placed = F.zip_with("parts", scores, lambda p, s: F.struct(F.round(s, 6).alias("score"), p.alias("part")))
    best = F.aggregate(placed, F.struct(F.lit(-1.0).alias("score"), F.lit("").alias("part")), lambda a, x: F.when(x["score"] > a["score"], x).otherwise(a), lambda a: a["part"])
    return rows.select("sample_key", "event_id", F.substring(F.coalesce(best, F.lit("")), 1, most).alias("excerpt"))


def within_budget(texts, most: int = 420):
    """Texts, in order, that are no repeats and fit what is left of the budget; one that doesn't fit is skipped, later ones may fit."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(0).alias("used"))
    fits = lambda acc, x: ~F.array_contains(acc["kept"], x) & (acc["used"] + F.length(x) <= most)
    return F.aggregate(
        texts,
        start,
        lambda acc, x: F.when(fits(acc, x), F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), (acc["used"] + F.length(x)).alias("used"))).otherwise(acc),
        lambda acc: acc["kept"],
    )


def hints(spark: SparkSession, sf_dir: str, top: int = 3) -> DataFrame:
    """``(sample_key, event_id, place, source)``: the top candidates, then the question's anchors not among them."""
    r, a = ranked_candidates(spark, sf_dir), known_anchors(spark, sf_dir)
    ranked = r.where(F.col("rnk") <= top).select("sample_key", "event_id", F.col("rnk").alias("place"))
    named = a.select("sample_key", F.posexplode("ids").alias("p", "event_id")).select("sample_key", "event_id", (F.lit(top + 1) + F.col("p")).alias("place"), F.lit(1).alias("anchor"))
    both = ranked.withColumn("anchor", F.lit(0)).unionByName(named).groupBy("sample_key", "event_id").agg(F.min("place").alias("first"), F.max("anchor").alias("anchor"))
    place = F.row_number().over(Window.partitionBy("sample_key").orderBy("first"))
    return both.select("sample_key", "event_id", place.alias("place"), F.when(F.col("anchor") == 1, "ranked+question_anchor").otherwise("ranked").alias("source"))


#: Query vectors that one pass compares with all others; 64 floats each make a megabyte of broadcast.
QUERY_BLOCK = 4096


def cosine_topk(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int = 5) -> DataFrame:
    """``(query_id, key, cosine, rnk)``: for each query row the k most similar other rows.

    Queries are taken in blocks of QUERY_BLOCK; each task keeps the k best for each query before the shuffle. Null vectors and
    vectors of no length are left out. Ties go to the lower key.
    """
    spark = vectors.sparkSession
    asked = queries.where(F.col(vector).isNotNull()).select(key, vector)
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    parts = []
    for p in range(blocks):
        own = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64(key), F.lit(blocks)) == p)
        rows = own.orderBy(key).collect()
        if not rows:
            continue
        ids = np.array([r[0] for r in rows])
        matrix = np.array([r[1] for r in rows], dtype=np.float64)
        norm = np.linalg.norm(matrix, axis=1)
        ids, matrix = ids[norm > 0], matrix[norm > 0] / norm[norm > 0, None]
        shared = spark.sparkContext.broadcast((ids, matrix))

        def scan(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, matrix = shared.value
            best_id, best = np.zeros((len(ids), 0), dtype=np.int64), np.zeros((len(ids), 0))
            for pdf in frames:
                pdf = pdf[pdf[vector].notna()]
                if not len(pdf):
                    continue
                m = np.stack(pdf[vector].to_numpy()).astype(np.float64)
                length = np.linalg.norm(m, axis=1)
                keys = pdf[key].to_numpy()[length > 0]
                sims = np.round(matrix @ (m[length > 0] / length[length > 0, None]).T, 6)
                sims[ids[:, None] == keys[None, :]] = -np.inf
                best_id, best = np.concatenate([best_id, np.broadcast_to(keys, sims.shape)], axis=1), np.concatenate([best, sims], axis=1)
                order = np.lexsort((best_id, -best), axis=1)[:, :k]
                best_id, best = np.take_along_axis(best_id, order, 1), np.take_along_axis(best, order, 1)
            if best.shape[1]:
                out = pd.DataFrame({"query_id": np.repeat(ids, best.shape[1]), key: best_id.ravel(), "cosine": best.ravel()})
                yield out[np.isfinite(out["cosine"])]

        parts.append(vectors.select(key, vector).mapInPandas(scan, f"query_id bigint, {key} bigint, cosine double"))
    if not parts:
        return spark.createDataFrame([], f"query_id bigint, {key} bigint, cosine double, rnk int")
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), key))
    return every.withColumn("rnk", place).where(F.col("rnk") <= k)
