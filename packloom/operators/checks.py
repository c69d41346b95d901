"""Joins that check one table against another: coverage, unknown and repeated keys, anti and semi joins, substitution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def coverage(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side with ``missing`` (expected but not seen) and ``unexpected`` (the other way), from one full outer join.

    Keys are distinct on each side first; a null key matches nothing and so is both missing and unexpected where it occurs.
    """
    e = expected.select(*keys).distinct().withColumn("__e", F.lit(True))
    s = seen.select(*keys).distinct().withColumn("__s", F.lit(True))
    both = e.join(s, keys, "full_outer")
    return both.select(*keys, F.col("__s").isNull().alias("missing"), F.col("__e").isNull().alias("unexpected"))


def violations(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``(key, violation)``: ``unknown`` for keys that ``known`` lacks, ``repeated`` for keys that occur more than once."""
    unknown = rows.select(key).distinct().join(known.select(key).distinct(), key, "left_anti").select(key, F.lit("unknown").alias("violation"))
    repeated = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("repeated").alias("violation"))
    return unknown.unionByName(repeated)


def same_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``(only_a, only_b)``: how many different rows one side has and the other lacks; both 0 for equal sets."""
    only_a, only_b = a.exceptAll(b).distinct(), b.exceptAll(a).distinct()
    tagged = only_a.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(only_b.select(F.lit(0).alias("a"), F.lit(1).alias("b")))
    return tagged.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("only_a"), F.coalesce(F.sum("b"), F.lit(0)).alias("only_b"))


def ordered_union(parts: list[DataFrame], key: str, group: str) -> DataFrame:
    """Rows of the parts, one for each key of a group: of equal keys the one of the first part, with its ``place`` in the union."""
    every = None
    for n, part in enumerate(parts):
        one = part.withColumn("place", F.lit(n))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(group, key).agg(F.min("place").alias("place"))


def substitute(old: DataFrame, new: DataFrame, keys: list[str], value: str, where: Column) -> DataFrame:
    """``old`` with ``value`` taken from ``new`` where there is one and ``where`` holds; ``changed`` tells which rows differ."""
    fresh = new.select(*keys, F.col(value).alias("__new"))
    joined = old.join(fresh, keys, "left")
    taken = F.when(where, F.coalesce("__new", value)).otherwise(F.col(value))
    return joined.withColumn("changed", ~F.col(value).eqNullSafe(taken)).withColumn(value, taken).drop("__new")
