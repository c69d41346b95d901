"""Held-out passages inside a large corpus, by size-partitioned MinHash containment search.

Items are partitioned by size. For each partition the documents are covered by half-overlapping windows as long as
its largest item, so a short item inside a long document still agrees with one window in a good share of its minima.
Pairs that agree often enough, over all windows of the document together, are verified by exact containment of shingles, in
runs. Items shorter than a shingle are searched for as they are.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.operators.skew import salted_join
from packloom.session import cut_lineage

#: Letters of a shingle, shingles of a block, minima of a signature, and agreeing minima that make a candidate.
K, BLOCK, PERMUTATIONS, AGREE = 12, 64, 48, 3
#: Shortest run that counts, by kind of writing; and the least share of an item inside such runs.
RUN_HAN, RUN_OTHER, SHARE = 24, 60, 0.5
#: Items whose sketches (about 3 kB each) are broadcast; beyond, evidence is shuffled to the items.
ITEMS_A_PASS = 4000
#: Bits of the largest bitmap, pieces of a document's candidates, and the mark of keys of items shorter than a shingle.
MOST_BITS, PIECES, SHORT = 1 << 28, 16, 63
#: Letters that are hashed at once.
CHUNK = 2_000_000

_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>")
_OTHER = re.compile(r"[\W_]+")
_RNG = np.random.default_rng(20260101)
_XOR = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64)
_MUL = _RNG.integers(0, 2**63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)
_NONE = np.uint32(0xFFFFFFFF)


def letters(text: str) -> str:
    """Letters and digits of ``text`` in one case and width, without markup, punctuation and invisible characters."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _MARKUP.sub("", text)
    return _OTHER.sub("", unicodedata.normalize("NFKC", text).casefold())


def shingle_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of every K letters of ``text`` (of K-1 too many at the end, which cross into nothing)."""
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        one = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        one = (one + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        one ^= one >> np.uint64(32)
        two = one[:-1] * base + one[1:]
        four = two[:-2] * (base * base) + two[2:]
        base4 = base * base * base * base
        eight = four[:-4] * base4 + four[4:]
        h = eight[:-4] * base4 + four[8:]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        h ^= h >> np.uint64(29)
    return h


def _minima(h: np.ndarray, starts: np.ndarray, dead: np.ndarray | None = None) -> np.ndarray:
    """Minimum of each permutation over h[starts[i]:starts[i+1]]; positions in ``dead`` don't count."""
    out = np.empty((PERMUTATIONS, len(starts)), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for j in range(PERMUTATIONS):
            v = (((h ^ _XOR[j]) * _MUL[j]) >> np.uint64(32)).astype(np.uint32)
            if dead is not None:
                v[dead] = _NONE
            out[j] = np.minimum.reduceat(v, starts)
    return out


def width_of(shingles: int) -> int:
    """Blocks of a window for an item of so many shingles: the next of 2, 3, 4, 6, 8, 12, ..."""
    need, w = -(-shingles // BLOCK), 2
    while w < need:
        w = w * 3 // 2 if w & (w - 1) == 0 else w * 4 // 3
    return w


class Prints:
    """Shingle hashes of items, for exact containment."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.hashes, self.size, self.run = [], [], [], []
        #: Items shorter than a shingle, by their letters.
        self.short: dict[str, list[int]] = {}
        for item, text in rows:
            bare = letters(text or "")
            if len(bare) < K:
                if bare:
                    self.short.setdefault(bare, []).append(item)
                continue
            han = sum("㐀" <= c <= "鿿" for c in bare)
            self.ids.append(item)
            self.hashes.append(shingle_hashes(bare))
            self.size.append(len(bare))
            self.run.append(min(RUN_HAN if han * 3 >= len(bare) else RUN_OTHER, len(bare)))

    def whole(self, texts: list[str]) -> list[tuple[int, int]]:
        """(text number, item id) of every text in which a short item occurs."""
        if not self.short:
            return []
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for bare, ids in self.short.items():
            automaton.add_word(bare, ids)
        automaton.make_automaton()
        return [(t, i) for t, text in enumerate(texts) for i in {i for _, ids in automaton.iter(text) for i in ids}] if len(automaton) else []

    def covered(self, item: int, text_hashes: np.ndarray) -> float:
        """Share of the item's letters in runs of shingles that the text (its sorted hashes) has, counting long runs only."""
        own = self.hashes[item]
        there = text_hashes[np.minimum(np.searchsorted(text_hashes, own), len(text_hashes) - 1)] == own
        if not there.any():
            return 0.0
        edge = np.diff(np.r_[0, there.astype(np.int8), 0])
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + K - 1
        long = end - begin >= self.run[item]
        inside = np.zeros(self.size[item] + 1, dtype=np.int32)
        np.add.at(inside, begin[long], 1)
        np.add.at(inside, end[long], -1)
        return float((np.cumsum(inside)[:-1] > 0).mean())


class Items(Prints):
    """Sketches of items, by size partition."""

    def __init__(self, rows: list[tuple[int, str]]):
        super().__init__(rows)
        widths = np.array([width_of(len(h)) for h in self.hashes], dtype=int)
        self.partitions = []
        for w in sorted(set(widths)):
            own = np.flatnonzero(widths == w)
            sketch = np.stack([_minima(self.hashes[i], np.zeros(1, dtype=int))[:, 0] for i in own], axis=1)
            tables = []
            for j in range(PERMUTATIONS):
                order = np.argsort(sketch[j], kind="stable")
                values, first, count = np.unique(sketch[j][order], return_index=True, return_counts=True)
                tables.append((values, first, count, own[order]))
            self.partitions.append((int(w), tables))


def windows(texts: list[str], widths: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, dict]]:
    """Texts (letters only) a CHUNK at a time: their numbers, all shingle hashes, first hash and number of letters of each, and by width
    the windows' texts and minima."""
    length = np.array([len(t) for t in texts], dtype=np.int64)
    keep = np.flatnonzero(length >= K)
    at = 0
    while at < len(keep):
        upto, total = at, 0
        while upto < len(keep) and (upto == at or total + length[keep[upto]] <= CHUNK):
            total += length[keep[upto]]
            upto += 1
        part = keep[at:upto]
        at = upto
        size = length[part]
        start = np.r_[0, np.cumsum(size)[:-1]]
        h = shingle_hashes("".join(texts[i] for i in part))
        # Shingles that cross into the next text.
        dead = (np.cumsum(size)[:-1, None] - np.arange(1, K)[None, :]).ravel()
        blocks = -(-(size - K + 1) // BLOCK)
        first = np.r_[0, np.cumsum(blocks)[:-1]]
        of_block = np.repeat(np.arange(len(part)), blocks)
        starts = start[of_block] + (np.arange(len(of_block)) - first[of_block]) * BLOCK
        minima = np.concatenate([_minima(h, starts, dead), np.full((PERMUTATIONS, 1), _NONE)], axis=1)
        by_width = {}
        for w in widths:
            stride = w // 2
            many = np.maximum(1, -(-(blocks - w) // stride) + 1)
            of = np.repeat(np.arange(len(part)), many)
            nth = np.arange(len(of)) - np.r_[0, np.cumsum(many)[:-1]][of]
            lo = first[of] + nth * stride
            hi = np.minimum(lo + w, first[of] + blocks[of])
            by_width[w] = of, np.minimum.reduceat(minima, np.stack([lo, hi], axis=1).ravel(), axis=1)[:, ::2]
        yield part, h, start, size, by_width


def search(items: Items, texts: list[str]) -> list[tuple[int, int]]:
    """(text number, item number) of every text that holds an item's share in long runs. ``texts`` are letters only."""
    found: list[tuple[int, int]] = []
    for part, h, start, size, by_width in windows(texts, [w for w, _ in items.partitions]):
        candidates = []
        for w, tables in items.partitions:
            of, own = by_width[w]
            keys = []
            for (values, begin, count, members), row in zip(tables, own, strict=True):
                p = np.minimum(np.searchsorted(values, row), len(values) - 1)
                hit = np.flatnonzero((values[p] == row) & (row != _NONE))
                n = count[p[hit]]
                offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                # An item may lie in several windows, a run in each: a minimum counts once in whichever it is found.
                keys.append(np.unique(np.repeat(of[hit], n) * len(items.ids) + members[np.repeat(begin[p[hit]], n) + offset]))
            pairs, agree = np.unique(np.concatenate(keys), return_counts=True)
            candidates.append(pairs[agree >= AGREE])
        last, there = -1, h
        for pair in np.unique(np.concatenate(candidates)) if candidates else ():
            t, item = divmod(int(pair), len(items.ids))
            if t != last:
                last, there = t, np.sort(h[start[t] : start[t] + size[t] - K + 1])
            if items.covered(item, there) >= SHARE:
                found.append((int(part[t]), item))
    return found


def _keys(width: int, j: np.ndarray | int, minima: np.ndarray) -> np.ndarray:
    """64-bit keys of minima, apart for each width and permutation."""
    with np.errstate(over="ignore"):
        k = minima.astype(np.uint64) + (np.asarray(j, dtype=np.uint64) << np.uint64(32)) + (np.uint64(width) << np.uint64(40))
        k *= np.uint64(0x9E3779B97F4A7C15)
        k ^= k >> np.uint64(32)
        k *= np.uint64(0xD6E8FEB86659FD93)
    return k ^ (k >> np.uint64(29))


def _grams(text: str, n: int) -> np.ndarray:
    """A 32-bit hash of every ``n`` letters in one."""
    one = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    out = np.zeros(max(0, len(one) - n + 1), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out + one[k : k + len(out)] + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
            out ^= out >> np.uint64(31)
    return out >> np.uint64(32)


class Bitmap:
    """A set of keys, one bit for each slot; it has at most MOST_BITS bits, and a false hit costs a later look, never a row."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    @classmethod
    def of(cls, keys: DataFrame, key: str) -> Bitmap:
        """From a column of 64-bit keys; slots are set in tasks, words of slots (at most an eighth of MOST_BITS bytes) reach the driver."""
        bits = min(MOST_BITS.bit_length() - 1, max(10, (16 * keys.count()).bit_length()))
        slot = F.shiftrightunsigned(F.col(key), 64 - bits)
        rows = keys.select(slot.alias("slot")).select(F.shiftright("slot", 6).cast("int").alias("word"), F.expr("shiftleft(1L, CAST(slot & 63 AS INT))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
        words = np.zeros(1 << (bits - 6), dtype=np.uint64)
        for b in rows.toArrow().to_batches():
            words[b.column(0).to_numpy()] = b.column(1).to_numpy().astype(np.int64).view(np.uint64)
        return cls(words, bits)

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot = keys >> np.uint64(64 - self.bits)
        return (self.words[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) == 1


def _doc_keys(ids: pa.Array) -> np.ndarray:
    return _keys(0, 0, np.asarray(ids.to_numpy(zero_copy_only=False), dtype=np.int64).view(np.uint64))


def _many(documents: DataFrame, doc_id: str, text: str, rows: DataFrame) -> DataFrame:
    """``leaked`` for more items than one pass sketches: evidence meets the items' minima in a shuffle, texts do not.

    Items are sketched in tasks. Documents are read once for evidence: the minima of their windows that a bitmap of all
    items' minima knows, with the document's id; agreeing ones are counted for each document and item. They are read a second
    time for the exact check, and only texts with candidates are shuffled, to meet their items.
    """
    spark = documents.sparkSession
    item, said = rows.columns

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known = Items(list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))
            out: list[tuple] = []
            for w, tables in known.partitions:
                for j, (values, begin, count, members) in enumerate(tables):
                    keys = np.repeat(_keys(w, j, values), count).view(np.int64).tolist()
                    out += [(known.ids[m], w, 1 << j, k) for m, k in zip(members.tolist(), keys, strict=True)]
            for bare, ids in known.short.items():
                key = int(_keys(len(bare), SHORT, _grams(bare, len(bare))).view(np.int64)[0])
                out += [(i, -len(bare), (1 << AGREE) - 1, key) for i in ids]
            yield pa.record_batch([pa.array([r[c] for r in out], pa.int64()) for c in range(4)], names=["item_id", "width", "marks", "key"])

    sketches = cut_lineage(rows.mapInArrow(sketch, "item_id bigint, width bigint, marks bigint, key bigint"))
    widths = sorted(r[0] for r in sketches.select("width").distinct().collect())
    shared = spark.sparkContext.broadcast(Bitmap.of(sketches.select("key").distinct(), "key"))

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            texts = [letters(t) if t else "" for t in b.column(1).to_pylist()]
            docs, keys = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.uint64)]
            for part, _, _, _, by_width in windows(texts, [w for w in widths if w > 0]):
                for w, (of, own) in by_width.items():
                    for j, row in enumerate(own):
                        k = _keys(w, j, row)
                        hit = np.flatnonzero(known.has(k) & (row != _NONE))
                        docs.append(part[of[hit]])
                        keys.append(k[hit])
            for w in widths:
                for t, bare in enumerate(texts) if w < 0 else ():
                    k = np.unique(_keys(-w, SHORT, _grams(bare, -w)))
                    k = k[known.has(k)]
                    docs.append(np.full(len(k), t))
                    keys.append(k)
            ids = b.column(0).take(pa.array(np.concatenate(docs)))
            yield pa.record_batch([ids, pa.array(np.concatenate(keys).view(np.int64))], names=["doc_id", "key"])

    texts = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id IS NOT NULL")
    hits = cut_lineage(texts.mapInArrow(evidence, "doc_id bigint, key bigint"))
    met = salted_join(hits, sketches.select("key", "item_id", "marks"), "key", ["doc_id"], "inner")
    pairs = cut_lineage(met.groupBy("doc_id", "item_id").agg(F.bit_or("marks").alias("marks")).where(F.bit_count("marks") >= AGREE).select("doc_id", "item_id"))
    wanted = spark.sparkContext.broadcast(Bitmap.of(pairs.select("doc_id").distinct().mapInArrow(lambda bs: (pa.record_batch([pa.array(_doc_keys(b.column(0)).view(np.int64))], names=["key"]) for b in bs), "key bigint"), "key"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value
        for b in batches:
            yield b.filter(pa.array(known.has(_doc_keys(b.column(0)))))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for doc, body, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                bare = letters(body) if body else ""
                there = np.sort(shingle_hashes(bare)) if len(bare) >= K else None
                known = Prints([(x["item_id"], x["said"]) for x in asked])
                found += [(doc, i) for n, i in enumerate(known.ids) if there is not None and known.covered(n, there) >= SHARE]
                found += [(doc, i) for short, ids in known.short.items() if short in bare for i in ids]
            yield pa.record_batch([pa.array([r[c] for r in found], pa.int64()) for c in (0, 1)], names=["doc_id", "item_id"])

    # A document's candidates come in pieces, so that no row grows with the number of items.
    piece = F.pmod(F.xxhash64("item_id"), F.lit(PIECES))
    asked = salted_join(pairs, rows.select(F.col(item).alias("item_id"), F.col(said).alias("said")), "item_id", ["doc_id"], "inner").groupBy("doc_id", piece.alias("piece")).agg(F.collect_list(F.struct("item_id", "said")).alias("asked"))
    return texts.mapInArrow(some, "doc_id bigint, text string").join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(check, "doc_id bigint, item_id bigint")


def leaked(documents: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``(doc_id, item_id)`` for each document that reproduces at least half of an item in long runs.

    Up to ITEMS_A_PASS items are sketched and broadcast, and documents are only read, once. More items stay where they are, and
    a bitmap of their minima, which has a bound whatever their number, is broadcast (see ``_many``). Null and blank texts hold nothing, and items without a letter or digit occur nowhere; an
    item shorter than the shortest run must occur whole. A document id that occurs twice gives
    its rows twice, a null one none.
    """
    spark = documents.sparkSession
    names = ("doc_id", "item_id")
    rows = items.select(F.col(item_id).cast("bigint"), F.col(item_text)).where(F.col(item_text).isNotNull())
    few = rows.limit(ITEMS_A_PASS + 1).collect()
    if len(few) > ITEMS_A_PASS:
        return _many(documents, doc_id, text, rows)
    sketches = spark.sparkContext.broadcast(Items([tuple(r) for r in few]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sketches.value
        for b in batches:
            ids = b.column(0)
            texts = [letters(t) if t else "" for t in b.column(1).to_pylist()]
            pairs = [(t, known.ids[i]) for t, i in search(known, texts)] if known.ids else []
            pairs += known.whole(texts)
            docs = pa.array([x for x, _ in pairs], pa.int64())
            yield pa.record_batch([ids.take(docs), pa.array([i for _, i in pairs], pa.int64())], names=names)

    return documents.select(F.col(doc_id).cast("bigint"), F.col(text)).where(F.col(doc_id).isNotNull()).mapInArrow(scan, "doc_id bigint, item_id bigint")
