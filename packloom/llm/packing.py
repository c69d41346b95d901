"""Filling containers of fixed capacity with texts measured in tokens.

Texts are spread over shards of bounded size; each shard is filled best-fit from the largest text down, and a swap-based
local search then moves texts, or exchanges one for one, two for one and one for two, between underfull bins so that the
squared fill grows until bins are empty. What underfull bins the shards keep is gathered and filled once more.
"""

from __future__ import annotations

import base64
import bisect
import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.session import cut_lineage

#: Vocabulary file of a public tokenizer (ranks of byte pairs) and its pattern of pieces.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PIECES = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts of a shard; fill below which a bin goes to the second filling; sizes of containers, of which more are refused.
SHARD, AGAIN, MOST_SIZES = 16_000, 0.98, 1000


@functools.cache
def tokenizer(path: str):
    """The byte-pair encoder of a vocabulary file."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, doc_id: str, text: str, path: str = TOKENIZER) -> DataFrame:
    """``(doc_id, tokens)`` of whole texts; null texts give no row, the empty text has no tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([len(encode(t)) for t in b.column(1).to_pylist()], pa.int64())], names=["doc_id", "tokens"])

    return df.select(F.col(doc_id).cast("bigint"), F.col(text)).where(F.col(text).isNotNull()).mapInArrow(count, "doc_id bigint, tokens bigint")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, list[int]]:
    """Bin of each item, largest first into the fullest bin with room, and the bins' fills."""
    where, fill = np.zeros(len(sizes), dtype=np.int64), []
    free: list[tuple[int, int]] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        s = int(sizes[i])
        k = bisect.bisect_left(free, (s, -1))
        if k < len(free):
            room, b = free.pop(k)
        else:
            room, b = capacity, len(fill)
            fill.append(0)
        where[i] = b
        fill[b] += s
        if room > s:
            bisect.insort(free, (room - s, b))
    return where, fill


class _Search:
    """Bins and their items, kept sorted by bin and size so that all bins are searched at once."""

    def __init__(self, sizes: np.ndarray, where: np.ndarray, full: np.ndarray, capacity: int):
        self.sizes, self.where, self.full, self.capacity = sizes, where, full, capacity
        self.wide = capacity + 1
        self.item = np.lexsort((sizes, where))
        self.key = where[self.item] * self.wide + sizes[self.item]

    def _take(self, i: int) -> None:
        k = self.where[i] * self.wide + self.sizes[i]
        at = int(np.searchsorted(self.key, k))
        while self.item[at] != i:
            at += 1
        self.key, self.item = np.delete(self.key, at), np.delete(self.item, at)

    def move(self, i: int, to: int) -> None:
        """Item ``i`` to bin ``to``."""
        self._take(i)
        s = int(self.sizes[i])
        self.full[self.where[i]] -= s
        self.full[to] += s
        self.where[i] = to
        k = to * self.wide + s
        at = int(np.searchsorted(self.key, k))
        self.key, self.item = np.insert(self.key, at, k), np.insert(self.item, at, i)

    def _least(self, bins: np.ndarray, need: np.ndarray, skip: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``item`` of the smallest item of each bin of size ``need`` or more, and whether there is one; never the place ``skip``."""
        base = bins * self.wide
        at = np.searchsorted(self.key, base + need)
        if skip is not None:
            at = np.where(at == skip, at + 1, at)
        inside = np.minimum(at, len(self.key) - 1)
        return inside, (at < len(self.key)) & (self.key[inside] // self.wide == bins)

    def empty(self, source: int) -> bool:
        """Give the items of ``source`` away, step by step, each of which raises the sum of squared fills; whether it is empty now.

        An item moves to the bin that it fills best. If none has room, items of the source are exchanged for smaller ones:
        one for one, two for one or one for two, over all items and all pairs within a bin, whichever gains most.
        """
        own = np.flatnonzero(self.where == source).tolist()
        while own:
            own.sort(key=lambda i: (-int(self.sizes[i]), i))
            room = self.capacity - self.full
            bins = np.flatnonzero(room > 0)
            bins = bins[(bins != source) & (self.full[bins] > 0)]
            room, left = room[bins], int(self.full[source])
            done = False
            tried = set()
            for i in own:
                s = int(self.sizes[i])
                if s in tried:
                    continue
                tried.add(s)
                fits = np.flatnonzero((room >= s) & (self.full[bins] + s > left))
                if len(fits):
                    self.move(i, int(bins[fits[np.argmin(room[fits])]]))
                    own.remove(i)
                    done = True
                    break
            if done:
                continue
            if not len(bins):
                return False
            best: tuple[int, tuple[int, ...], tuple[int, ...]] = (0, (), ())
            one = {int(self.sizes[i]): (i,) for i in reversed(own)}
            # Items of one size are alike, and a bin has few different sizes: their sum is at most its capacity.
            again = {}
            for i in own:
                if i != one[int(self.sizes[i])][0]:
                    again.setdefault(int(self.sizes[i]), i)
            two = {}
            for a, (i,) in one.items():
                for b, (j,) in one.items():
                    if b < a:
                        two.setdefault(a + b, (i, j))
                if a in again:
                    two.setdefault(2 * a, (i, again[a]))
            for give in (one, two):
                for total, items in give.items():
                    # One smaller item of a bin.
                    at, there = self._least(bins, np.clip(total - room, 1, self.capacity))
                    gain = np.where(there & (total - room <= self.capacity), total - self.sizes[self.item[at]], 0)
                    gain[(gain > room) | (self.full[bins] + gain <= left)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (int(gain[k]), items, (int(self.item[at[k]]),))
            # Two smaller items of a bin.
            held = self.key // self.wide
            free = self.capacity - self.full[held]
            with_room = np.flatnonzero((free > 0) & (held != source))
            held, free, first = held[with_room], free[with_room], self.sizes[self.item[with_room]]
            for total, items in one.items():
                small = np.flatnonzero(first < total)
                if len(small):
                    at, there = self._least(held[small], np.clip(total - free[small] - first[small], 1, self.capacity), with_room[small])
                    gain = np.where(there, total - first[small] - self.sizes[self.item[at]], 0)
                    gain[(gain > free[small]) | (self.full[held[small]] + gain <= left)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (int(gain[k]), items, (int(self.item[with_room[small[k]]]), int(self.item[at[k]])))
            gain, give, take = best
            if not gain:
                return False
            to = int(self.where[take[0]])
            for i in give:
                self.move(i, to)
                own.remove(i)
            for i in take:
                self.move(i, source)
                own.append(i)
        return True


def local_search(sizes: np.ndarray, where: np.ndarray, fill: list[int], capacity: int) -> np.ndarray:
    """Bins after emptying as many underfull bins as exchanges can.

    Every underfull bin is tried, from the least filled on, and all of them again while one was emptied. The search
    ends at the least possible number of bins. It ends, for each step raises the sum of squared fills.
    """
    search = _Search(sizes, where.copy(), np.array(fill, dtype=np.int64), capacity)
    least, alive = -(-int(sizes.sum()) // capacity), len(fill)
    emptied = True
    while emptied and alive > least:
        emptied = False
        for source in np.argsort(search.full, kind="stable").tolist():
            if alive <= least:
                break
            if 0 < search.full[source] < capacity and search.empty(source):
                alive, emptied = alive - 1, True
    return search.where


def fill_shard(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item of one shard."""
    if not len(sizes):
        return np.zeros(0, dtype=np.int64)
    where, fill = best_fit(sizes, capacity)
    return local_search(sizes, where, fill, capacity)


PLACED = "container string, bin string, doc_id bigint, part int, start bigint, tokens bigint, filled bigint, capacity bigint"


def _fill(items: DataFrame, stage: int) -> DataFrame:
    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part"], kind="stable").reset_index(drop=True)
        capacity = int(pdf["capacity"].iloc[0])
        where = fill_shard(pdf["tokens"].to_numpy(dtype=np.int64), capacity)
        pdf["filled"] = np.bincount(where, weights=pdf["tokens"]).astype(np.int64)[where]
        pdf["bin"] = [f"{stage}.{s}.{w}" for s, w in zip(pdf["shard"], where)]
        return pdf[[c.split()[0] for c in PLACED.split(", ")]]

    return items.groupBy("container", "shard").applyInPandas(place, PLACED)


def pack(counts: DataFrame, containers: DataFrame) -> DataFrame:
    """Place texts in bins: ``(container, bin, doc_id, part, start, tokens, filled, capacity)``.

    ``counts(doc_id, tokens)``, ``containers(container, capacity)``. A text is divided only when it alone exceeds the
    capacity: into full parts and a rest, numbered by ``part``, beginning at token ``start``. Texts without tokens and
    containers without capacity give no rows. The shard of a text depends on its id alone, so no shard grows with the table.
    """
    spark = counts.sparkSession
    n = counts.count()
    shards = max(1, -(-n // SHARD))
    sizes = [(r[0], int(r[1])) for r in containers.where("capacity > 0").select("container", "capacity").distinct().orderBy("container").limit(MOST_SIZES + 1).collect()]
    if len(sizes) > MOST_SIZES:
        raise ValueError(f"more than {MOST_SIZES} container sizes")
    kinds = F.array(*[F.struct(F.lit(c).alias("container"), F.lit(n).cast("bigint").alias("capacity")) for c, n in sizes])
    if not sizes:
        return spark.createDataFrame([], PLACED)
    items = (
        counts.where("tokens > 0")
        .withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
        .select("*", F.inline(kinds))
        .withColumn("part", F.explode(F.sequence(F.lit(0), ((F.col("tokens") - 1) / F.col("capacity")).cast("int"))))
        .withColumn("start", F.col("part") * F.col("capacity"))
        .withColumn("tokens", F.least(F.col("tokens") - F.col("start"), "capacity"))
    )
    first = cut_lineage(_fill(items, 0))
    poor = F.col("filled") < F.col("capacity") * AGAIN
    rest = first.where(poor)
    groups = max(1, -(-rest.count() // SHARD))
    again = _fill(rest.select("container", "doc_id", "part", "start", "tokens", "capacity", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).alias("shard")), 1)
    return first.where(~poor).unionByName(again)
