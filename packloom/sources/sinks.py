"""Sinks: resumable append-only results, JSON lines by partition, small JSON files written whole."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder of JSON lines for each combination of the ``by`` columns, null members written out."""
    df.write.mode("overwrite").partitionBy(*by).option("ignoreNullFields", "false").json(path)


def write_json(value, path: str) -> None:
    """A small JSON document on any file system that Spark reaches, complete or as it was before.

    It is written beside its place and renamed over it by the file system in one operation.
    """
    spark = SparkSession.getActiveSession()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}-{uuid.uuid4().hex}")
    stream = target.getFileSystem(conf).create(draft, True)
    try:
        stream.write(bytearray(json.dumps(value, ensure_ascii=False, sort_keys=True).encode()))
    finally:
        stream.close()
    over = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    fs = target.getFileSystem(conf)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf).rename(fs.makeQualified(draft), fs.makeQualified(target), over)


class ResultStore:
    """Append-only results under one signature, so that an interrupted run goes on where it stopped.

    ``signature`` names what the results depend on; opening a store with another one raises an error. With ``valid``, a
    condition on a result's columns, results that do not meet it count as not there: they are done again and not handed out.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, signature: dict, valid: Column | None = None):
        self.spark, self.path, self.key = spark, path, key
        self.valid = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
        self._rows, mark = f"{path}/rows", f"{path}/signature"
        wanted = json.dumps(signature, sort_keys=True, ensure_ascii=False)
        fs_path = spark._jvm.org.apache.hadoop.fs.Path(mark)
        if fs_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs_path):
            found = spark.read.text(mark, wholetext=True).first()[0].strip()
            if found != wanted:
                raise ValueError("the store was written under another signature")
        else:
            spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.text(mark)

    def _exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self._rows)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def open_items(self, items: DataFrame) -> DataFrame:
        """The items whose key has no result yet."""
        if not self._exists():
            return items
        done = self.spark.read.parquet(self._rows).where(self.valid).select(self.key).distinct()
        return items.join(done, self.key, "left_anti")

    def append(self, results: DataFrame) -> None:
        """Add results; the writer's commit protocol leaves no partial files."""
        results.write.mode("append").parquet(self._rows)

    def finish(self, expected: DataFrame) -> DataFrame:
        """All results, one for each key; an error if expected keys lack a result or results have unexpected keys."""
        rows = self.spark.read.parquet(self._rows).where(self.valid).dropDuplicates([self.key])
        want = expected.select(self.key).distinct()
        lacking = want.join(rows, self.key, "left_anti").limit(5).collect()
        other = rows.join(want, self.key, "left_anti").limit(5).collect()
        if lacking or other:
            raise ValueError(f"missing {[r[0] for r in lacking]}, unexpected {[r[self.key] for r in other]}")
        return rows


def missing_from_cache(texts: DataFrame, text: str, cache: DataFrame) -> DataFrame:
    """``(digest, text)`` of the different texts that a table keyed by their digest does not have."""
    keyed = texts.where(F.col(text).isNotNull()).select(F.sha2(F.col(text), 256).alias("digest"), F.col(text).alias("text")).dropDuplicates(["digest"])
    return keyed.join(cache.select("digest"), "digest", "left_anti")
