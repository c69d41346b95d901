"""A gate that opens when a value stays at or below a threshold for long enough; any breach resets it.

The batch form finds runs with windows in two levels, so that no key's whole history is sorted in one task. The streaming form
keeps the start of the current run for each key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Seconds of a bucket of the first level.
BUCKET = 6 * 3600


def idle_runs(df: DataFrame, key: str, ts: str, tie: str, value: str, threshold: float, bucket: int = BUCKET) -> DataFrame:
    """``(key, run_start, run_end, samples)``: the longest stretches of samples at or below the threshold.

    Order is by ``ts`` and, at equal times, ``tie``. A null value is a breach; rows with a null key or time are left out. Runs are
    found inside buckets of time; only a bucket's first and last run can go on in a neighbour, and only those meet in
    the second window.
    """
    rows = df.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(
        F.col(key).alias("k"), F.col(ts).alias("t"), F.col(tie).alias("tie"), F.coalesce(F.col(value) <= threshold, F.lit(False)).alias("ok"), F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / bucket).alias("b")
    )
    w = Window.partitionBy("k", "b").orderBy("t", "tie")
    marked = rows.withColumn("breaches", F.sum((~F.col("ok")).cast("int")).over(w)).withColumn("all_breaches", F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("k", "b")))
    runs = marked.where("ok").groupBy("k", "b", "breaches", "all_breaches").agg(F.min("t").alias("start"), F.max("t").alias("end"), F.count(F.lit(1)).alias("n"))
    # Buckets without an idle sample break a chain of buckets; whole buckets pass it on.
    inner = runs.where("breaches > 0 AND breaches < all_breaches").select("k", "start", "end", "n")
    edge = runs.where("breaches = 0 OR breaches = all_breaches")
    closed = marked.groupBy("k", "b").agg(F.max("all_breaches").alias("x")).where("x > 0").select("k", "b")
    # A breach lies between two edge runs of one bucket and in every bucket that has only breaches.
    at = edge.select("k", "b", F.when(F.col("breaches") == 0, 0).otherwise(2).alias("side"), "start", "end", "n", F.lit(0).alias("wall"))
    at = at.unionByName(closed.select("k", "b", F.lit(1).alias("side"), F.lit(None).cast(rows.schema["t"].dataType).alias("start"), F.lit(None).cast(rows.schema["t"].dataType).alias("end"), F.lit(0).cast("bigint").alias("n"), F.lit(1).alias("wall")))
    walls = F.sum("wall").over(Window.partitionBy("k").orderBy("b", "side").rowsBetween(Window.unboundedPreceding, 0))
    merged = at.withColumn("island", walls).where("wall = 0").groupBy("k", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n"))
    return inner.unionByName(merged.select("k", "start", "end", "n")).select(F.col("k").alias(key), F.col("start").alias("run_start"), F.col("end").alias("run_end"), F.col("n").alias("samples"))


def idle_gate(df: DataFrame, key: str, ts: str, tie: str, value: str, threshold: float, seconds: int) -> DataFrame:
    """The runs that last at least ``seconds`` from their first to their last sample: those that open the gate."""
    runs = idle_runs(df, key, ts, tie, value, threshold)
    lasted = F.unix_micros(F.col("run_end").cast("timestamp")) - F.unix_micros(F.col("run_start").cast("timestamp"))
    return runs.where(lasted >= seconds * 1_000_000)


def idle_gate_stream(stream: DataFrame, key: str, ts: str, value: str, threshold: float, seconds: int, delay: str = "1 hour") -> DataFrame:
    """The moments at which the gate opens, from a stream: ``(key, run_start, opened_at)``, one for each run.

    Samples of a key are taken in the order of their times inside a micro-batch; a sample older than the run's last is late and
    dropped. State is the run's start, its last time and whether it has opened; keys idle beyond the watermark's delay lose it.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, last, opened = state.get if state.exists else (None, None, False)
        out = []
        for pdf in frames:
            for t, v in pdf.sort_values(ts)[[ts, value]].itertuples(index=False):
                us = int(pd.Timestamp(t).value // 1000)
                if last is not None and us < last:
                    continue
                last = us
                if v is None or v != v or v > threshold:
                    start, opened = None, False
                    continue
                start = us if start is None else start
                if not opened and us - start >= seconds * 1_000_000:
                    opened = True
                    out.append((k[0], pd.Timestamp(start, unit="us"), pd.Timestamp(us, unit="us")))
        state.update((start, last, opened))
        state.setTimeoutTimestamp((last or 0) // 1000 + 2 * 3600 * 1000)
        yield pd.DataFrame(out, columns=[key, "run_start", "opened_at"])

    kind = stream.schema[key].dataType.simpleString()
    grouped = stream.select(key, ts, value).withWatermark(ts, delay).groupBy(key)
    return grouped.applyInPandasWithState(step, f"{key} {kind}, run_start timestamp, opened_at timestamp", "start bigint, last bigint, opened boolean", "append", GroupStateTimeout.EventTimeTimeout)
