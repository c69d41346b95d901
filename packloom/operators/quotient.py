"""Exactly-once selection of messages with exact quotient hash tables.

An identifier of fixed width is permuted by a bijection; the upper bits of the result are its quotient, which
names a shard and a home slot, and the table stores the complete words, of which a slot's comparison looks at all.
Two identifiers meet only if all their bits agree, so there are no false matches, and as the permutation can be undone
the entries tell the identifiers. Identifiers of other widths have tables of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows for which there is a shard, about; a task holds the table of one shard at a time.
SHARD_ROWS = 1 << 18
#: Entries after which a task's own table is emptied into the shuffle, which bounds its memory.
FLUSH_AT = 400_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def permute(words: np.ndarray) -> np.ndarray:
    """A bijection on rows of 64-bit words: every step is an odd multiplication, a shift-xor or a Feistel step."""
    w = words.copy()
    m = w.shape[1]
    with np.errstate(over="ignore"):
        for r in range(3):
            for j in range(m):
                x = w[:, (j + 1) % m] * _ODD[(r + j) % 4]
                if m > 1:
                    w[:, j] ^= x ^ (x >> np.uint64(29))
                w[:, j] *= _ODD[(r + j + 1) % 4]
                w[:, j] ^= w[:, j] >> np.uint64(32)
    return w


def unpermute(words: np.ndarray) -> np.ndarray:
    """The rows that ``permute`` has made ``words`` of."""
    w = words.copy()
    m = w.shape[1]
    inverse = [np.uint64(pow(int(x), -1, 1 << 64)) for x in _ODD]
    with np.errstate(over="ignore"):
        for r in reversed(range(3)):
            for j in reversed(range(m)):
                w[:, j] ^= w[:, j] >> np.uint64(32)
                w[:, j] *= inverse[(r + j + 1) % 4]
                if m > 1:
                    x = w[:, (j + 1) % m] * _ODD[(r + j) % 4]
                    w[:, j] ^= x ^ (x >> np.uint64(29))
    return w


class QuotientTable:
    """Open addressing by quotient; holds for each identifier its lowest value. The topmost ``above`` bits name its shard."""

    def __init__(self, width: int, bits: int = 12, above: int = 0):
        self.width, self.bits, self.size, self.above = width, bits, 0, above
        self._new()

    def _new(self) -> None:
        n = 1 << self.bits
        self.used = np.zeros(n, dtype=bool)
        self.words = np.zeros((n, self.width), dtype=np.uint64)
        self.value = np.zeros(n, dtype=np.int64)

    def _grow(self, more: int) -> None:
        if (self.size + more) * 2 <= 1 << self.bits:
            return
        words, value = self.words[self.used], self.value[self.used]
        while (self.size + more) * 2 > 1 << self.bits:
            self.bits += 1
        self.size = 0
        self._new()
        self._put(words, value)

    def insert(self, words: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Insert permuted identifiers; return the values that another, not greater, value of the same identifier displaces."""
        self._grow(len(values))
        return self._put(words, values)

    def _put(self, words: np.ndarray, values: np.ndarray) -> np.ndarray:
        mask = np.uint64((1 << self.bits) - 1)
        # The bits below the shard's name the home slot.
        slot = ((words[:, 0] >> np.uint64(max(0, 64 - self.above - self.bits))) & mask).astype(np.int64)
        pending, out = np.arange(len(values)), []
        while len(pending):
            s = slot[pending]
            free = ~self.used[s]
            taken, first = np.unique(s[free], return_index=True)
            new = pending[free][first]
            self.used[taken], self.words[taken], self.value[taken] = True, words[new], values[new]
            self.size += len(new)
            keep = np.ones(len(pending), dtype=bool)
            keep[np.flatnonzero(free)[first]] = False
            pending, s = pending[keep], s[keep]
            same = (self.words[s] == words[pending]).all(axis=1)
            if same.any():
                hit = s[same]
                slots = np.unique(hit)
                at, val = np.concatenate([slots, hit]), np.concatenate([self.value[slots], values[pending[same]]])
                order = np.lexsort((val, at))
                at, val = at[order], val[order]
                lead = np.r_[True, at[1:] != at[:-1]]
                self.value[at[lead]] = val[lead]
                out.append(val[~lead])
            pending = pending[~same]
            slot[pending] = (slot[pending] + 1) & int(mask)
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        """All entries; the table is empty after it."""
        words, value = self.words[self.used], self.value[self.used]
        self.size = 0
        self._new()
        return words, value


_SCHEMA = pa.schema([("shard", pa.int32()), ("words", pa.binary()), ("value", pa.int64()), ("surplus", pa.bool_())])
_TYPES = "shard int, words binary, value bigint, surplus boolean"


def _shard(word: np.ndarray, bits: int) -> np.ndarray:
    return (word >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(word), dtype=np.int32)


def _binary(words: np.ndarray) -> pa.Array:
    n, width = len(words), words.shape[1] * 8
    offsets = pa.py_buffer((np.arange(n + 1) * width).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), n, [None, offsets, pa.py_buffer(np.ascontiguousarray(words))])


def _batch(words: np.ndarray | None, value: np.ndarray, surplus: bool, bits: int) -> pa.RecordBatch:
    n = len(value)
    if words is None:
        with np.errstate(over="ignore"):
            shard = _shard(value.astype(np.uint64) * _ODD[0], bits)
        raw = pa.nulls(n, pa.binary())
    else:
        shard, raw = _shard(words[:, 0], bits), _binary(words)
    return pa.record_batch([pa.array(shard), raw, pa.array(value), pa.array(np.full(n, surplus))], schema=_SCHEMA)


def _matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each width of a column of identifiers: places, and words of its rows."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False)
    for width in np.unique(size):
        at = np.flatnonzero(size == width)
        data = b"".join(column.take(pa.array(at)).to_pylist())
        yield at, np.frombuffer(data, dtype=np.uint64).reshape(len(at), -1)


def identifier(columns: Sequence[Column]) -> Column:
    """Byte strings of a fixed width, of which there are few: for each column its length and its bytes, padded to a power of two of words."""
    parts = []
    for c in columns:
        b = F.encode(c, "UTF-8")
        parts += [F.unhex(F.lpad(F.hex(F.octet_length(b)), 8, "0")), b]
    whole = F.concat(*parts)
    words = F.ceil(F.octet_length(whole) / 8)
    return F.rpad(whole, (8 * F.pow(F.lit(2), F.ceil(F.log2(words)))).cast("int"), F.unhex(F.lit("00")))


def deliveries(df: DataFrame, keys: Sequence[Column], order: str) -> DataFrame:
    """Tell for each row with complete keys whether it is surplus: ``(id, value, surplus)``, one row a row.

    The row with the lowest ``order`` (a BIGINT) of each identifier is not surplus and has its ``id``, as ``identifier`` gives
    it; of rows that tie in it one is not surplus. Rows with a null key or a null order are left out. Each task first
    removes repeats among its own rows, so a repeated identifier crosses the shuffle at most once a task, and its surplus
    rows spread over all shards. The number of shards follows the number of rows, and a task drains one shard's
    table before it begins the next, so its memory has a bound at every size. A key of another length is in a table of its width.
    """
    rows = df.select(F.col(order).cast("bigint").alias("value"), *[c.alias(f"k{i}") for i, c in enumerate(keys)]).dropna()
    bits = min(30, max(0, (df.count() // SHARD_ROWS).bit_length() + 4))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, QuotientTable] = {}
        for b in batches:
            for at, ids in _matrices(b.column(1)):
                table = own.setdefault(ids.shape[1], QuotientTable(ids.shape[1]))
                yield _batch(None, table.insert(permute(ids), b.column(0).to_numpy()[at]), True, bits)
            if sum(t.size for t in own.values()) > FLUSH_AT:
                for t in own.values():
                    yield _batch(*t.drain(), False, bits)
                own = {}
        for t in own.values():
            yield _batch(*t.drain(), False, bits)

    def drained(own: dict[int, QuotientTable]) -> Iterator[pa.RecordBatch]:
        for t in own.values():
            words, value = t.drain()
            yield pa.record_batch([_binary(unpermute(words)), pa.array(value), pa.array(np.zeros(len(value), dtype=bool))], names=["id", "value", "surplus"])

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: dict[int, QuotientTable] = {}
        now = None

        def gone(value) -> pa.RecordBatch:
            return pa.record_batch([pa.nulls(len(value), pa.binary()), pa.array(value, pa.int64()), pa.array(np.ones(len(value), dtype=bool))], names=["id", "value", "surplus"])

        for b in batches:
            yield gone(b.column(2).filter(b.column(3)))
            rest = b.filter(pc.invert(b.column(3)))
            shards = rest.column(0).to_numpy()
            for piece in np.split(np.arange(len(shards)), np.flatnonzero(np.diff(shards)) + 1):
                if not len(piece):
                    continue
                if shards[piece[0]] != now:
                    yield from drained(own)
                    own, now = {}, shards[piece[0]]
                part = rest.slice(int(piece[0]), len(piece))
                for at, words in _matrices(part.column(1)):
                    table = own.setdefault(words.shape[1], QuotientTable(words.shape[1], above=bits))
                    yield gone(table.insert(words, part.column(2).to_numpy()[at]))
        yield from drained(own)

    return (
        rows.select("value", identifier([F.col(f"k{i}") for i in range(len(keys))]).alias("id"))
        .mapInArrow(local, _TYPES)
        .repartition("shard")
        .sortWithinPartitions("shard")
        .mapInArrow(shard, "id binary, value bigint, surplus boolean")
    )


def surplus(df: DataFrame, keys: Sequence[Column], order: str) -> DataFrame:
    """The ``order`` values of the rows that are to go. Rows with null keys are never surplus."""
    return deliveries(df, keys, order).where("surplus").select(F.col("value").alias(order))


def keep_once(df: DataFrame, keys: Sequence[Column], order: str) -> DataFrame:
    """``df`` with exactly one row an identifier; rows with a null key or order stay as they are.

    Of rows that tie in ``order`` within an identifier one stays; rows of different identifiers may share an ``order``.
    """
    whole = F.col(order).isNotNull()
    for k in keys:
        whole = whole & k.isNotNull()
    kept = deliveries(df, keys, order).where(~F.col("surplus")).select(F.col("value").alias("__value"), F.col("id").alias("__id"))
    named = df.where(whole).withColumn("__id", identifier(keys)).withColumn("__value", F.col(order).cast("bigint"))
    once = named.join(kept, ["__id", "__value"], "left_semi").dropDuplicates(["__id", "__value"]).drop("__id", "__value")
    return once.unionByName(df.where(~whole))
