"""Readers of the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df``, which no join up to the next one may broadcast, for the driver would have to hold it.

    The engine goes by the size of the compressed files, which texts and repeated keys exceed many times, and takes no note of
    what ``explode`` adds or what a set gathers. The hint holds through selections, windows, aggregates and ``explode``.
    """
    return df.hint("merge")


def canonical_sample_id(col: Column | str) -> Column:
    """Sample ids denote the same thing regardless of letter case and surrounding blanks."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def canonical_digest(col: Column | str) -> Column:
    """Digests denote the same thing regardless of case, blanks and a naming prefix such as ``sha256:``, ``sha256=`` or ``sha-256 ``.

    A digest of nothing but blanks counts as null.
    """
    c = F.col(col) if isinstance(col, str) else col
    bare = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)^(?:[^:=]*[:=]|sha-?[0-9]+[-_\s])\s*", "")
    return F.nullif(bare, F.lit(""))


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970 of a time column; times without a zone count as UTC whatever the session's zone is."""
    c = F.col(name)
    if dict(df.dtypes)[name] == "timestamp_ntz":
        c = F.from_utc_timestamp(c.cast("timestamp"), F.current_timezone())
    return F.unix_micros(c.cast("timestamp"))
