"""Joins on keys of which one may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

#: A key is hot when it holds more than one in HOT_SHARE of all rows; so there are fewer than HOT_SHARE hot keys.
HOT_SHARE = 64
#: Number of pieces into which the rows of a hot key are split.
PIECES = 32


def hot_keys(df: DataFrame, key: str, share: int = HOT_SHARE) -> list:
    """Keys with more than 1/share of the rows of ``df``: at most ``share`` values reach the driver.

    Counts are combined before the shuffle. Null keys never count, for they never match. Keys of PIECES rows or
    fewer are never hot.
    """
    total = Observation()
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n")).observe(total, F.sum("n").alias("rows"))
    # One job: the rows are counted while the greatest keys are picked.
    top = counts.orderBy(F.desc("n")).limit(share).collect()
    return [r[0] for r in top if r["n"] > max(total.get["rows"] // share, PIECES)] if top else []


def salted_join(left: DataFrame, right: DataFrame, key: str, piece_by: Sequence[str], how: str = "left", hot: list | None = None) -> DataFrame:
    """Equi-join on ``key`` with the left rows of hot keys split over PIECES tasks.

    ``piece_by`` names left columns whose hash picks the piece, so a recomputed task picks the same. The
    right rows of hot keys, and no others, are repeated once a piece. ``how`` is inner or left. Other columns
    of the two sides must differ in name. Null keys match nothing.
    """
    if hot is None:
        hot = hot_keys(left, key)
    if not hot:
        return left.join(right, key, how)
    is_hot = F.col(key).isin(hot)
    pieces = F.when(is_hot, F.pmod(F.xxhash64(*piece_by), F.lit(PIECES)).cast("int")).otherwise(F.lit(0))
    copies = F.when(is_hot, F.sequence(F.lit(0), F.lit(PIECES - 1))).otherwise(F.array(F.lit(0)))
    return (
        left.withColumn("__piece", pieces)
        .join(right.withColumn("__piece", F.explode(copies)), [key, "__piece"], how)
        .drop("__piece")
    )
