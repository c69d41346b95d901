"""Splits that keep related records together.

Records (packs) and entities (texts) form a bipartite graph. Minimum labels travel along it until nothing changes;
whole groups then go to splits so that sizes and label distributions deviate least from the given shares.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.operators.components import propagate  # noqa: F401 (part of this module's interface)
from packloom.operators.skew import hot_keys, salted_join
from packloom.session import cut_lineage

#: Hash buckets of strata, and of groups within a stratum. Their product bounds the parcels the driver sees.
STRATA, BUCKETS = 32, 64
#: A group with more than one in OWN_PARCEL of all records is a parcel of its own.
OWN_PARCEL = 1024
#: Label values that count one by one in the deviation; rarer ones count by hash, POOLS of them.
LABELS, POOLS = 512, 64


def normalized(text: str) -> str:
    """``text`` without white space, letter case and width (compatibility) differences."""
    return "".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = []
        for text in b.column(1).to_pylist():
            bare = normalized(text) if text else ""
            out.append(hashlib.blake2b(bare.encode("utf-8", "surrogatepass"), digest_size=16).digest() if bare else None)
        yield pa.record_batch([b.column(0), pa.array(out, pa.binary())], names=["record", "entity"])


def text_links(df: DataFrame, record: str, text: str) -> DataFrame:
    """Distinct ``(record, entity)`` of the texts that occur, apart from layout, in two or more records.

    Null records, null and blank texts link nothing.
    """
    rows = df.select(F.col(record).cast("string").alias("record"), F.col(text).alias("text")).where("record IS NOT NULL AND text IS NOT NULL")
    links = rows.mapInArrow(_entities, "record string, entity binary").where("entity IS NOT NULL").groupBy("entity", "record").agg(F.lit(1).alias("one")).drop("one")
    links = cut_lineage(links)
    shared = links.groupBy("entity").agg(F.min("record").alias("lo"), F.max("record").alias("hi")).where("lo <> hi").select("entity")
    return salted_join(links, shared, "entity", ["record"], "inner").select("record", "entity")


def assign_parcels(counts: np.ndarray, shares: np.ndarray, rounds: int = 20) -> np.ndarray:
    """Split number of each parcel (rows of ``counts``: amounts by label; the first column is the size).

    Greedy from the largest, then moves and exchanges while they lower the sum over splits and labels of the squared
    deviation from the share, relative to the label's total.
    """
    n, total = len(counts), counts.sum(axis=0)
    weight = 1 / np.maximum(total, 1)
    weight[0] *= 4
    want = shares[:, None] * total
    have = np.zeros_like(want)
    split, size = np.zeros(n, dtype=np.int64), (counts**2) @ weight
    cost = lambda h, x: (((h + x - want) ** 2 - (h - want) ** 2) * weight).sum(axis=1)
    for i in np.lexsort((np.arange(n), -counts[:, 0])):
        # Relative to the share, so that a small split isn't filled at once.
        split[i] = np.argmin(cost(have, counts[i]) / np.maximum(shares, 1e-9) if have.sum() == 0 else cost(have, counts[i]))
        have[split[i]] += counts[i]
    for _ in range(rounds):
        moved = 0
        for i in range(n):
            s = split[i]
            gain = cost(have, counts[i]) + cost(have, -counts[i])[s]
            gain[s] = 0
            t = int(np.argmin(gain))
            if gain[t] < -1e-12:
                have[s] -= counts[i]
                have[t] += counts[i]
                split[i], moved = t, moved + 1
        lean = None
        for i in range(n):
            # Exchange with the parcel of another split that helps most.
            if lean is None:
                lean = counts @ ((have - want) * weight).T
            s = split[i]
            others = np.flatnonzero(split != s)
            if not len(others):
                break
            t = split[others]
            # The gain is a quadratic form in the difference of the two parcels.
            square = size[others] - 2 * (counts[others] @ (weight * counts[i])) + size[i]
            gain = 2 * (lean[others, s] - lean[i, s] - lean[others, t] + lean[i, t]) + 2 * square
            k = int(np.argmin(gain))
            if gain[k] < -1e-9:
                j = others[k]
                have[s] += counts[j] - counts[i]
                have[split[j]] -= counts[j] - counts[i]
                split[i], split[j], moved, lean = split[j], s, moved + 1, None
        if not moved:
            break
    return split


def assign_groups(groups: DataFrame, labels: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``(record, grp, split_name)`` from ``groups(record, grp)`` and ``labels(record, label, n)``.

    All records of a group get one split. Every label value counts in the deviation: the LABELS commonest each by itself,
    the others in POOLS by hash. Groups are gathered in parcels (by hash within the stratum of the group's
    commonest label; large groups alone), of which there are at most STRATA * BUCKETS + OWN_PARCEL. Only the
    parcels' label counts reach the driver. A table without records gives no rows.
    """
    total = groups.count()
    by_label = labels.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS)
    known = [r[0] for r in by_label.collect()]
    few = hot_keys(groups, "grp")
    sizes = groups.groupBy("grp").agg(F.count(F.lit(1)).alias("size"))
    named = labels.groupBy("record", F.when(F.col("label").isin(known), F.col("label")).otherwise(F.concat(F.lit("\u0001"), F.pmod(F.xxhash64("label"), F.lit(POOLS)))).alias("label")).agg(F.sum("n").alias("n"))
    of_group = salted_join(named, groups, "record", ["label"], "inner").groupBy("grp", "label").agg(F.sum("n").alias("n"))
    chief = of_group.groupBy("grp").agg(F.max_by("label", F.struct("n", "label")).alias("chief"))
    placed = sizes.join(chief, "grp", "left").select(
        "grp",
        "size",
        F.when(F.col("size") * OWN_PARCEL > total, F.concat(F.lit("g:"), "grp"))
        .otherwise(F.concat_ws(":", F.lit("p"), F.pmod(F.xxhash64(F.coalesce("chief", F.lit(""))), F.lit(STRATA)), F.pmod(F.xxhash64("grp", F.lit(7)), F.lit(BUCKETS))))
        .alias("parcel"),
    )
    placed = cut_lineage(placed)
    amounts = of_group.join(placed, "grp").groupBy("parcel", "label").agg(F.sum("n").cast("double").alias("n"))
    amounts = amounts.unionByName(placed.groupBy("parcel").agg(F.sum("size").cast("double").alias("n")).withColumn("label", F.lit("")))
    table = amounts.toPandas()
    names = list(shares)
    if not len(table) or not names:
        return groups.select("record", "grp", F.lit(None).cast("string").alias("split_name")).where(F.lit(False))
    wide = table.pivot_table(index="parcel", columns="label", values="n", fill_value=0.0).sort_index()
    wide = wide[["", *sorted(c for c in wide.columns if c != "")]]
    given = np.array([shares[s] for s in names], dtype=float)
    split = assign_parcels(wide.to_numpy(), given / given.sum())
    where = groups.sparkSession.createDataFrame([(p, names[s]) for p, s in zip(wide.index, split, strict=True)], "parcel string, split_name string")
    # At most STRATA * BUCKETS + OWN_PARCEL rows.
    assigned = placed.join(F.broadcast(where), "parcel").select("grp", "split_name")
    return salted_join(groups, assigned, "grp", ["record"], "inner", few).select("record", "grp", "split_name")


def balance(assigned: DataFrame, labels: DataFrame, shares: dict[str, float]) -> DataFrame:
    """``(split_name, records, share, target, deviation, worst)`` of each split with records.

    ``deviation`` is the mean, over the label values weighed by their amount, of the distance between the split's share of the
    value and its target share; ``worst`` the largest such distance among values of 100 or more. Both are null without labels.
    """
    sizes = assigned.groupBy("split_name").agg(F.count(F.lit(1)).alias("records"))
    n, whole = assigned.count(), sum(shares.values())
    target = F.coalesce(*[F.when(F.col("split_name") == s, F.lit(v / whole)) for s, v in sorted(shares.items())])
    inside = labels.join(assigned.select("record", "split_name"), "record").groupBy("label").pivot("split_name", sorted(shares)).agg(F.sum("n"))
    parts = inside.select("label", F.explode(F.map_from_arrays(F.array(*[F.lit(s) for s in sorted(shares)]), F.array(*[F.coalesce(F.col(f"`{s}`"), F.lit(0)) for s in sorted(shares)]))).alias("split_name", "n"))
    total = parts.groupBy("label").agg(F.sum("n").alias("total"))
    far = parts.join(total, "label").withColumn("off", F.abs(F.col("n") / F.col("total") - target))
    far = far.groupBy("split_name").agg(F.round(F.sum(F.col("off") * F.col("total")) / F.sum("total"), 6).alias("deviation"), F.round(F.max(F.when(F.col("total") >= 100, F.col("off"))), 6).alias("worst"))
    return sizes.join(far, "split_name", "left").select("split_name", "records", F.round(F.col("records") / F.lit(max(1, n)), 6).alias("share"), target.alias("target"), "deviation", "worst")
