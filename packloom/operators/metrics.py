"""Answer, chain and fact metrics as expressions, and statistics over them."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions import text as T
from packloom.session import cut_lineage

REFUSAL = "无法确定"


def letters(text: Column) -> Column:
    """Letters and digits of a text, one by one, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}])"), F.lit(1))


def char_f1(pairs: DataFrame, a: str, b: str, to: str = "f1") -> DataFrame:
    """``pairs`` with the multiset F1 of the letters and digits of two columns.

    Both without letters: 1; one without, or null: 0. The rows' letters are counted with arrays inside the row, so nothing is
    shuffled: shared letters are those that sorting one list after the other's distinct letters finds.
    """
    x, y = letters(F.coalesce(F.col(a), F.lit(""))), letters(F.coalesce(F.col(b), F.lit("")))
    both = F.struct(x.alias("x"), y.alias("y"))

    def score(p: Column) -> Column:
        total = F.size(p["x"]) + F.size(p["y"])
        # Removing from the joined list what only one side has leaves every shared letter twice.
        times = lambda arr, c: F.size(F.filter(arr, lambda z: z == c))
        shared = F.aggregate(F.array_distinct(F.array_intersect(p["x"], p["y"])), F.lit(0), lambda acc, c: acc + F.least(times(p["x"], c), times(p["y"], c)))
        return F.when((F.size(p["x"]) == 0) | (F.size(p["y"]) == 0), (total == 0).cast("double")).otherwise(2.0 * shared / total)

    return pairs.withColumn(to, T.let(both, score))


def set_f1(a: Column, b: Column) -> Column:
    """Twice the common elements over both lengths (repeats count in the lengths); both empty: 1."""
    total = F.size(a) + F.size(b)
    return F.when(total == 0, 1.0).otherwise(2.0 * F.size(F.array_intersect(a, b)) / total)


def best_alternative(chain: Column, alternatives: Column) -> dict[str, Column]:
    """Exact hit, node F1 and edge F1 of a chain: the greatest over whole alternatives; without any, the empty one counts."""
    some = F.when(F.size(alternatives) > 0, alternatives).otherwise(F.array(F.array().cast("array<string>")))
    return {
        "exact": F.exists(some, lambda c: c == chain).cast("double"),
        "node_f1": F.array_max(F.transform(some, lambda c: set_f1(chain, c))),
        "edge_f1": F.array_max(F.transform(some, lambda c: set_f1(T.steps(chain), T.steps(c)))),
    }


def transitions(a: Column, b: Column) -> Column:
    """gain, loss, both_hit or both_miss from an old and a new success."""
    return F.when(~a & b, "gain").when(a & ~b, "loss").when(a & b, "both_hit").otherwise("both_miss")


def bootstrap_sums(rows: DataFrame, key: str, value: str, replicates: int, seed: int, stratum: str | None = None) -> DataFrame:
    """``(stratum, rep, n, total)``: sums of as many values as a stratum has rows, drawn with replacement by a digest of seed, replicate and place.

    Without ``stratum`` all rows are one, named by the empty text. ``rows`` are numbered by key in buckets, not in one task; each replicate draws
    row numbers from the digest. Draws join values by number: replicates times rows go through one shuffle and are summed before the next.
    """
    own = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"), (F.lit("") if stratum is None else F.coalesce(F.col(stratum).cast("string"), F.lit(""))).alias("stratum"))
    numbered = numbered_rows(own, "k", group="stratum")
    sizes = own.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    draws = numbered.select("stratum", "number").join(sizes, "stratum").select("stratum", "number", "n", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep"))
    digest = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), "rep", "number"), 256), 1, 12), 16, 10).cast("bigint")
    draws = draws.select("stratum", "rep", (digest % F.col("n")).alias("number"))
    return draws.join(numbered.select("stratum", "number", "v"), ["stratum", "number"]).groupBy("stratum", "rep").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


def bootstrap_means(rows: DataFrame, key: str, value: str, replicates: int, seed: int, stratum: str | None = None, chunk: int = 4096) -> DataFrame:
    """``(stratum, rep, n, total)`` like ``bootstrap_sums``, for thousands of replicates: draws never leave the task that makes them.

    Each stratum's values lie in chunks of about ``chunk`` rows, by a digest of the key. How many of a replicate's draws fall to each chunk
    is one multinomial draw over the chunks' sizes; inside a chunk they are drawn evenly with replacement. That is the plain bootstrap.
    Generators are seeded by seed, stratum and replicate or chunk. Only a replicate's count and sum in each chunk are shuffled.
    """
    own = rows.where(F.col(value).isNotNull()).select(F.col(key).cast("string").alias("k"), F.col(value).cast("double").alias("v"), (F.lit("") if stratum is None else F.coalesce(F.col(stratum).cast("string"), F.lit(""))).alias("stratum"))
    sizes = own.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    values = cut_lineage(own.join(sizes, "stratum").select("stratum", F.pmod(F.xxhash64("k"), F.ceil(F.col("n") / chunk)).cast("int").alias("chunk"), "k", "v"))
    held = values.groupBy("stratum", "chunk").agg(F.count(F.lit(1)).alias("rows"))
    lists = held.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("chunk", "rows"))).alias("chunks"))
    blocks = lists.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 100))))

    def allot(batches):
        for pdf in batches:
            for name, chunks, block in zip(pdf["stratum"], pdf["chunks"], pdf["block"]):
                size = np.array([c["rows"] for c in chunks])
                share, label = size / size.sum(), zlib.crc32(name.encode())
                reps = range(100 * block, min(replicates, 100 * block + 100))
                takes = np.array([np.random.default_rng([seed, label, r]).multinomial(size.sum(), share) for r in reps])
                yield pd.DataFrame({"stratum": name, "chunk": np.tile([c["chunk"] for c in chunks], len(reps)), "rep": np.repeat(list(reps), len(chunks)), "take": takes.ravel()})

    def draw(key: tuple, held: pd.DataFrame, takes: pd.DataFrame) -> pd.DataFrame:
        v = held.sort_values("k")["v"].to_numpy()
        rng = np.random.default_rng([seed, zlib.crc32(key[0].encode()), replicates + int(key[1])])
        takes = takes.sort_values("rep")
        total = [v[rng.integers(0, len(v), t, dtype=np.int32)].sum() for t in takes["take"]]
        return pd.DataFrame({"stratum": key[0], "rep": takes["rep"], "n": takes["take"], "total": total})

    takes = blocks.repartition(F.col("stratum"), F.col("block")).mapInPandas(allot, "stratum string, chunk int, rep int, take long")
    by = ["stratum", "chunk"]
    drawn = values.groupBy(*by).cogroup(takes.groupBy(*by)).applyInPandas(draw, "stratum string, rep int, n long, total double")
    return drawn.groupBy("stratum", "rep").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def numbered_rows(rows: DataFrame, key: str, buckets: int = 256, group: str | None = None) -> DataFrame:
    """``rows`` with ``number`` from 0, in each group, in the order of (bucket of the key's digest, key); only the buckets' sizes meet in one task."""
    g = [] if group is None else [group]
    hashed = rows.withColumn("__b", F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 2), 16, 10).cast("int") % buckets)
    sizes = hashed.groupBy(*g, "__b").agg(F.count(F.lit(1)).alias("__n"))
    offsets = sizes.select(*g, "__b", (F.sum("__n").over(Window.partitionBy(*g).orderBy("__b")) - F.col("__n")).alias("__at"))
    place = F.row_number().over(Window.partitionBy(*g, "__b").orderBy(key)) - 1
    return hashed.withColumn("__p", place).join(offsets, [*g, "__b"]).withColumn("number", F.col("__at") + F.col("__p")).drop("__b", "__p", "__at")


def nearest_rank(rows: DataFrame, group: str, value: str, percents: list[int]) -> DataFrame:
    """``(group, percent, value)``: the value at place round((n-1)p/100), halves to even, of each group's sorted values.

    Values are first counted, so the window holds the distinct values of a group, not its rows.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(group)
    upto = counts.withColumn("hi", F.sum("n").over(w.orderBy(value))).withColumn("total", F.sum("n").over(w))
    at = upto.withColumn("percent", F.explode(F.array(*[F.lit(p) for p in percents])))
    place = F.bround((F.col("total") - 1) * F.col("percent") / 100)
    return at.where((place < F.col("hi")) & (place >= F.col("hi") - F.col("n"))).select(group, "percent", F.col(value).alias("value"))


def smoothed(successes: Column, n: Column) -> Column:
    """Success rate under a Beta(2, 2) prior."""
    return (successes + 2) / (n + 4)
