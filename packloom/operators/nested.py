"""Nested JSON records as a store of distinct objects, with bridge rows for every occurrence.

Objects and arrays are hashed bottom-up over their canonical form, so equal subtrees have one identity. The
store has three relations: ``root`` (record -> identity), ``edge`` (parent identity, member, ordinal -> child identity
or scalar) and, implied by the edges, the objects themselves. An occurrence of a subtree in a record is
a path of edges from the record's root.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.operators.skew import hot_keys, salted_join
from packloom.session import delete_shared, write_shared

#: Identities a task remembers so as not to send a subtree again; beyond it the shuffle removes the repeats.
REMEMBER = 200_000
#: What may stand around JSON text: its own blanks, other white space and a byte-order mark.
_AROUND = "\ufeff \t\n\r\f\v\u00a0\u3000"

_BEGINS = frozenset('{["' + _AROUND)

EDGE = "parent binary, member string, ordinal int, child binary, kind string, value string, root_id bigint"
_SCHEMA = pa.schema(
    [("parent", pa.binary()), ("member", pa.string()), ("ordinal", pa.int32()), ("child", pa.binary()), ("kind", pa.string()), ("value", pa.string()), ("root_id", pa.int64())]
)


class _Number(str):
    """A JSON number as it was written, so that no digit is lost."""


class _Constant(str):
    """NaN or an infinity, which some writers put where JSON has no number."""


_DECODER = json.JSONDecoder(parse_constant=_Constant, parse_float=_Number, parse_int=_Number)
_PIECE = re.compile(r'[ \t\n\r]*(?:([\[\]{},:])|("(?:[^"\\\x00-\x1f]|\\.)*")|([^ \t\n\r\[\]{},:"]+))', re.S)


def _parsed_deep(text: str):
    """``text`` parsed with a stack of its own, for values nested deeper than the decoder's recursion goes."""
    top: list = []
    stack: list = [top]
    names: list = [None]
    ready, at = "value", 0
    while True:
        m = _PIECE.match(text, at)
        if m is None:
            if text[at:].strip(" \t\n\r") or len(stack) > 1 or ready != "end":
                raise ValueError(at)
            return top[0]
        at = m.end()
        sign, held = m[1], stack[-1]
        if sign is None or sign in "[{":
            if ready == "name" or ready == "first name":
                if m[2] is None:
                    raise ValueError(at)
                names[-1], ready = _DECODER.decode(m[2]), ":"
                continue
            if ready not in ("value", "first value"):
                raise ValueError(at)
            value = ([] if sign == "[" else {}) if sign else _DECODER.decode(m[2] or m[3])
            if type(held) is dict:
                held[names[-1]] = value
            else:
                held.append(value)
            if sign:
                stack.append(value)
                names.append(None)
                ready = "first value" if sign == "[" else "first name"
            else:
                ready = "," if len(stack) > 1 else "end"
        elif sign == ":" and ready == ":":
            ready = "value"
        elif sign == "," and ready == ",":
            ready = "name" if type(held) is dict else "value"
        elif sign in "]}" and len(stack) > 1 and (type(held) is list) == (sign == "]") and ready in (",", "first value", "first name"):
            stack.pop()
            names.pop()
            ready = "," if len(stack) > 1 else "end"
        else:
            raise ValueError(at)


def opened(value):
    """``value``, or what it holds if it is text that is itself a complete JSON object or array, however often it was quoted."""
    while type(value) is str and value[:1] in _BEGINS:
        text = value.strip(_AROUND)
        if text[:1] not in ("{", "[", '"'):
            return value
        try:
            inner = _DECODER.decode(text)
        except RecursionError:
            try:
                inner = _parsed_deep(text)
            except ValueError:
                return value
        except ValueError:
            return value
        if type(inner) is str and inner.strip(_AROUND)[:1] not in ("{", "[", '"'):
            return value
        value = inner
    return value


_KINDS = {type(None): "null", bool: "boolean", _Number: "number", _Constant: "constant", str: "text"}


_BOOLEANS = {True: "true", False: "false"}


def _frame(value) -> tuple[Iterator, list[str], list[tuple]]:
    """Members still to come, the canonical form so far, and the rows."""
    if type(value) is list:
        return zip(itertools.repeat(None), value), ["["], []
    return iter(sorted(value.items())), ["{"], []


def shred(value, sink) -> bytes:
    """Identity of an object or array; ``sink(identity, rows)`` gets the edge rows (member, ordinal, child, kind, value) below it.

    Members of an object are ordered by name, elements of an array keep their place, so that objects that differ in
    the order of their members only are the same. Values are walked with a stack of their own, so no depth is too deep.
    """
    items, form, rows = _frame(value)
    above: list[tuple] = []
    while True:
        for name, child in items:
            shape = type(child)
            if shape is str and child[:1] in _BEGINS:
                child = opened(child)
                shape = type(child)
            kind = _KINDS.get(shape)
            if kind is None:
                above.append((items, form, rows, name, "array" if shape is list else "object"))
                items, form, rows = _frame(child)
                break
            # Lengths go first, so no two different objects have one form.
            if child is None:
                text, told = None, kind
            else:
                text = _BOOLEANS[child] if shape is bool else child
                told = f"{kind}{len(text)}:{text}"
            form.append(told if name is None else f"{len(name)}:{name}{told}")
            rows.append((name, len(rows), None, kind, text))
        else:
            identity = hashlib.blake2b("".join(form).encode("utf-8", "surrogatepass"), digest_size=16).digest()
            sink(identity, rows)
            if not above:
                return identity
            items, form, rows, name, kind = above.pop()
            form.append(f"{kind}{identity.hex()}" if name is None else f"{len(name)}:{name}{kind}{identity.hex()}")
            rows.append((name, len(rows), identity, kind, None))


def _texts(values: list[str | None]) -> pa.Array:
    try:
        return pa.array(values, pa.string())
    except UnicodeEncodeError:  # half a surrogate pair
        return pa.array([v if v is None else v.encode("utf-8", "replace").decode("utf-8") for v in values], pa.string())


def _shredder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: set[bytes] = set()
    for b in batches:
        out: list[tuple] = []

        def sink(identity: bytes, rows: list[tuple]) -> None:
            if identity not in known:
                known.add(identity)
                out.append((identity, None, -1, None, "self" if rows else "empty", None, None))
                out.extend([(identity, *r, None) for r in rows])

        for rid, payload, row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if payload is not None and type(value := opened(payload)) is dict:
                # The row's number stands for the parent, so that roots spread even if they are all the same.
                out.append((str(row).encode(), None, -1, shred(value, sink), "root", None, rid))
        if len(known) > REMEMBER:
            known = set()
        if out:
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([_texts(x) if t == pa.string() else pa.array(x, t) for x, t in zip(columns, _SCHEMA.types, strict=True)], schema=_SCHEMA)


class Store:
    """The relations of shredded records: ``roots(record, root)``, ``edges(parent, member, ordinal, child, kind, value)`` and ``nodes(node)``."""

    def __init__(self, df: DataFrame, record: str, payload: str | Column):
        """Shred ``payload`` (JSON text) of ``df``, whose ``record`` is a BIGINT key.

        Null, broken, empty and non-object payloads give nothing; a byte-order mark before the text does not count.
        Text that holds a JSON object or array counts as that object or array, at any depth. NaN and infinities are scalars of
        kind ``constant``. A record that occurs twice has two roots.

        Equal rows below one parent are equal in all columns, so the distinct rows are the distinct places. They are brought
        together once, by parent, and written to the checkpoint folder ordered by kind and member, so that a step of a path
        reads the row groups of its members.
        """
        col = F.col(f"`{payload}`") if isinstance(payload, str) else payload
        # The row's number keeps records that are equal in key and payload apart.
        rows = df.select(F.col(f"`{record}`").cast("bigint"), col, F.monotonically_increasing_id()).where(col.isNotNull()).mapInArrow(_shredder, EDGE)
        placed = rows.repartition("parent").distinct()
        self._rows = write_shared(placed.sortWithinPartitions("kind", "member"))
        self.roots = self._rows.where("kind = 'root'").select(F.col("root_id").alias(record), F.col("child").alias("root"))
        #: Bridge rows, one for each place below each distinct parent.
        self.edges = self._rows.where("kind NOT IN ('root', 'self', 'empty')").drop("root_id")
        #: The identity of every distinct object and array.
        self.nodes = self._rows.where("kind IN ('self', 'empty')").select(F.col("parent").alias("node"))

    def hot(self) -> list:
        """Identities that hold a large share of all references, at most ``skew.HOT_SHARE``; each step's join splits their rows."""
        return hot_keys(self._rows.where("child IS NOT NULL"), "child")

    def release(self) -> None:
        """Delete the written relations; nothing derived from the store can be read after it."""
        delete_shared(self._rows)


def whole_number(text: Column) -> Column:
    """A JSON number, or text that is one, as a whole number in decimal digits; null if it isn't whole."""
    bare = F.trim(text)
    plain = F.when(bare.rlike(r"^[+-]?[0-9]+(\.0*)?$"), F.regexp_extract(bare, r"^\+?(-?[0-9]+)", 1))
    exact = F.when(bare.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]{1,2}$"), bare.try_cast("decimal(38,8)"))
    plain = F.coalesce(plain, F.when(exact == F.floor(exact), F.regexp_replace(exact.cast("string"), r"\..*$", "")))
    digits = F.regexp_replace(plain, r"^(-?)0+(?=[0-9])", "$1")
    return F.when(digits == "-0", F.lit("0")).otherwise(digits)


_SCALAR = "kind IN ('text', 'number')"


def _above(edges: DataFrame, below: DataFrame, hot: list) -> DataFrame:
    """Rows of ``below(node, ...)`` handed to every place that refers to their node: ``(parent, member, ordinal, ...)``."""
    left = edges.select("parent", "member", "ordinal", F.col("child").alias("node"))
    return salted_join(left, below, "node", ["parent", "ordinal"], "inner", hot).drop("node")


def run_log_children(store: Store, record: str = "record_id") -> DataFrame:
    """Flat child rows of run logs: ``(record_id, child, parent_pos, pos, item)``.

    ``chain`` and ``usage`` rows belong to an element of ``attempts`` (place ``parent_pos``; 0 for a lone object), ``group``
    rows to a member of ``groups`` (both places -1). Null or missing values give no row.

    Rows are derived bottom-up, once for each distinct object: ids and counts of the lowest objects go to the arrays and
    objects that refer to them, from there to attempts, lists, roots and, in the last step, to the records. So every
    join's larger side is bridge rows as the store has them, and one count of references tells the hot ones for all.
    """
    e, hot = store.edges, store.hot()
    arrays, objects = e.where("member IS NULL"), e.where("kind = 'object'")
    # The lowest objects: an event with its id, a group with its total and perhaps its name.
    ids = e.where(f"member = 'event_id' AND {_SCALAR}").select(F.col("parent").alias("node"), F.trim("value").alias("item")).where("item <> ''")
    totals = e.where(f"member IN ('all', 'name') AND {_SCALAR}").groupBy(F.col("parent").alias("node")).agg(
        F.max(F.when(F.col("member") == "all", F.col("value"))).alias("total"), F.max(F.when((F.col("member") == "name") & (F.col("kind") == "text"), F.col("value"))).alias("own_name")
    )
    totals = totals.select("node", whole_number(F.col("total")).alias("item"), "own_name").where("item IS NOT NULL")
    low = _above(objects, ids.withColumn("own_name", F.lit(None).cast("string")).withColumn("of", F.lit("event")).unionByName(totals.withColumn("of", F.lit("group"))), hot)
    # Chains: arrays of ids or of events, a lone event; and what a usage counts.
    text = arrays.where(_SCALAR).select(F.col("parent").alias("node"), F.col("ordinal").alias("pos"), F.trim("value").alias("item")).where("item <> ''")
    listed = low.where("of = 'event' AND member IS NULL").select(F.col("parent").alias("node"), F.col("ordinal").alias("pos"), "item")
    chains = text.unionByName(listed).unionByName(ids.select("node", F.lit(0).alias("pos"), "item")).withColumn("child", F.lit("chain"))
    tokens = e.where(f"member = 'prompt_tokens' AND {_SCALAR}").select(F.col("parent").alias("node"), F.lit(0).alias("pos"), whole_number(F.col("value")).alias("item"), F.lit("usage").alias("child"))
    held = _above(e.where("(member = 'evidence_chain' AND kind IN ('array', 'object')) OR (member = 'usage' AND kind = 'object')"), chains.unionByName(tokens.where("item IS NOT NULL")), hot)
    held = held.where("(member = 'usage') = (child = 'usage')").select(F.col("parent").alias("node"), "child", "pos", "item")
    bare = e.where("member = 'evidence_chain' AND kind = 'text'").select(F.col("parent").alias("node"), F.lit("chain").alias("child"), F.lit(0).alias("pos"), F.trim("value").alias("item")).where("item <> ''")
    # Attempts, alone or in a list.
    own = _above(objects.where("member IN ('parsed', 'attempt')"), held.unionByName(bare), hot).where("(member = 'attempt') = (child = 'usage')")
    own = own.select(F.col("parent").alias("node"), "child", "pos", "item")
    many = _above(objects.where("member IS NULL"), own, hot).select(F.col("parent").alias("node"), F.col("ordinal").alias("parent_pos"), "child", "pos", "item")
    groups = low.where("of = 'group'").withColumn("label", F.coalesce("member", "own_name")).where("label IS NOT NULL")
    groups = groups.select(F.col("parent").alias("node"), F.lit(-1).alias("parent_pos"), F.lit("group").alias("child"), F.lit(-1).alias("pos"), F.concat("label", F.lit("="), "item").alias("item"))
    parts = many.unionByName(own.withColumn("parent_pos", F.lit(0))).unionByName(groups)
    # Roots, and the records that have them.
    top = _above(e.where("member IN ('attempts', 'groups') AND kind IN ('array', 'object')"), parts, hot).where("(member = 'groups') = (child = 'group')")
    rows = salted_join(store.roots, top.withColumnRenamed("parent", "root").drop("member", "ordinal"), "root", [record], "inner", hot)
    return rows.select(record, "child", "parent_pos", "pos", "item")


def flat_tables(df: DataFrame, struct: str, key: str) -> dict[str, DataFrame]:
    """The same store for a struct column (such as ``attempt``): its JSON form is shredded, so typed rows and raw logs share identities."""
    store = Store(df, key, F.to_json(F.col(struct)))
    return {"roots": store.roots, "edges": store.edges, "nodes": store.nodes}
