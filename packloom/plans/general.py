"""Queries of the general training-data operators, with SQL where SQL can tell the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packloom.operators import quotient
from packloom.operators.nested import Store, flat_tables, run_log_children
from packloom.sources.tables import canonical_digest, canonical_sample_id, table


def _message_keys() -> list:
    return [canonical_sample_id("sample_id"), canonical_digest("input_sha256")]


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Surplus deliveries of attempts."""
    return quotient.surplus(table(spark, sf_dir, "attempts"), _message_keys(), "delivery_id")


def p2_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts with one delivery of each message."""
    kept = quotient.keep_once(table(spark, sf_dir, "attempts"), _message_keys(), "delivery_id")
    return kept.select("delivery_id", "batch_id", canonical_sample_id("sample_id").alias("sample_key"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chain elements, prompt tokens and group totals of raw_records."""
    return run_log_children(Store(table(spark, sf_dir, "raw_records"), "record_id", "payload"))


def p4_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridge rows below all distinct objects of raw_records."""
    edges = Store(table(spark, sf_dir, "raw_records"), "record_id", "payload").edges
    return edges.select(F.hex("parent").alias("parent"), "member", "ordinal", F.hex("child").alias("child"), "kind", "value")


def p4_attempt_structs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt tokens of the struct column ``attempt`` of attempts, through its distinct objects."""
    store = flat_tables(table(spark, sf_dir, "attempts"), "attempt", "delivery_id")
    usage = store["edges"].where("member = 'usage' AND kind = 'object'").select(F.col("parent").alias("root"), F.col("child").alias("u"))
    tokens = store["edges"].where("member = 'prompt_tokens' AND kind = 'number'").select(F.col("parent").alias("u"), F.col("value").cast("bigint").alias("prompt_tokens"))
    return store["roots"].join(usage, "root").join(tokens, "u").select("delivery_id", "prompt_tokens")


QUERIES = {"p2_found": p2_found, "p2_kept": p2_kept, "p4_found": p4_found, "p4_store": p4_store, "p4_attempt_structs": p4_attempt_structs}

_KEYED = r"""
WITH a AS (
  SELECT delivery_id, batch_id, lower(regexp_replace(sample_id, '^\s+|\s+$', '', 'g')) AS sample_key,
         nullif(regexp_replace(lower(regexp_replace(input_sha256, '^\s+|\s+$', '', 'g')), '^(?:[^:=]*[:=]|sha-?[0-9]+[-_\s])\s*', ''), '') AS digest
  FROM attempts),
r AS (SELECT *, row_number() OVER (PARTITION BY sample_key, digest ORDER BY delivery_id) AS nth FROM a)
"""

_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(65279)"


def _open(x: str, times: int = 3) -> str:
    """SQL for a JSON value, or what it holds if it is text that is itself an object or array."""
    for _ in range(times):
        x = f"coalesce(CASE WHEN json_type({x}) = 'VARCHAR' AND substr(trim({x}->>'$', {_BLANKS}), 1, 1) IN ('{{', '[', '\"') THEN try_cast(trim({x}->>'$', {_BLANKS}) AS JSON) END, {x})"
    return x


def _steps(name: str, source: str, keep: str, *members: tuple[str, str]) -> str:
    """CTEs that open the named members of ``source``, one level of quotation a step."""
    names = ", ".join(to for _, to in members)
    out = [f"{name}_0 AS (SELECT {keep}, {', '.join(f'{m} AS {to}' for m, to in members)} FROM {source})"]
    for i in range(3):
        out.append(f"{name}_{i + 1} AS (SELECT {keep}, {', '.join(f'{_open(to, 1)} AS {to}' for _, to in members)} FROM {name}_{i})")
    return ",\n".join(out) + f",\n{name} AS (SELECT {keep}, {names} FROM {name}_3)"


_WHOLE = r"""
CASE WHEN regexp_full_match(n, '[+-]?[0-9]+(\.0*)?') THEN CASE WHEN regexp_full_match(n, '[+-]?0+(\.0*)?') THEN '0' ELSE regexp_replace(regexp_replace(n, '^\+|\..*$', '', 'g'), '^(-?)0+', '\1') END
     WHEN regexp_full_match(n, '[+-]?[0-9]+(\.[0-9]+)?[eE][+-]?[0-9]{1,2}') AND try_cast(n AS DECIMAL(38,8)) = floor(try_cast(n AS DECIMAL(38,8))) THEN regexp_replace(try_cast(n AS DECIMAL(38,8))::VARCHAR, '\..*$', '') END
"""
_NUMERIC = "('BIGINT', 'UBIGINT', 'HUGEINT', 'UHUGEINT', 'DOUBLE', 'DECIMAL', 'VARCHAR')"
_P4 = ",\n".join(
    [
        "WITH whole AS (SELECT record_id, to_json(payload) AS p FROM raw_records WHERE payload IS NOT NULL)",
        _steps("rec", "whole", "record_id", ("p", "r")),
        _steps("two", "rec WHERE json_type(r) = 'OBJECT'", "record_id", ("r->'attempts'", "a"), ("r->'groups'", "g")),
        "lists AS (SELECT record_id, unnest(range(len(a->'$[*]'))) AS parent_pos, unnest(a->'$[*]') AS x FROM two WHERE json_type(a) = 'ARRAY' UNION ALL SELECT record_id, 0, a FROM two WHERE json_type(a) = 'OBJECT')",
        _steps("att", "lists", "record_id, parent_pos", ("x", "x")),
        _steps("sub", "att WHERE json_type(x) = 'OBJECT'", "record_id, parent_pos", ("x->'parsed'", "d"), ("x->'attempt'", "t")),
        _steps("leaf", "sub", "record_id, parent_pos", ("CASE WHEN json_type(d) = 'OBJECT' THEN d->'evidence_chain' END", "c"), ("CASE WHEN json_type(t) = 'OBJECT' THEN t->'usage' END", "u")),
        "elem AS (SELECT record_id, parent_pos, unnest(range(len(c->'$[*]'))) AS pos, unnest(c->'$[*]') AS y FROM leaf WHERE json_type(c) = 'ARRAY' UNION ALL SELECT record_id, parent_pos, 0, c FROM leaf WHERE json_type(c) IN ('OBJECT', 'VARCHAR'))",
        _steps("ev", "elem", "record_id, parent_pos, pos", ("y", "y")),
        "named AS (SELECT record_id, parent_pos, pos, CASE WHEN json_type(y) = 'OBJECT' THEN y->'event_id' ELSE y END AS y FROM ev)",
        "grp AS (SELECT record_id, k, g->k AS h FROM (SELECT record_id, g, unnest(json_keys(g)) AS k FROM two WHERE json_type(g) = 'OBJECT') UNION ALL SELECT record_id, NULL, unnest(g->'$[*]') FROM two WHERE json_type(g) = 'ARRAY')",
        _steps("gr", "grp", "record_id, k", ("h", "h")),
        "counts AS (SELECT record_id, coalesce(k, CASE WHEN json_type(h->'name') = 'VARCHAR' THEN h->>'name' END) AS label, CASE WHEN json_type(h->'all') IN " + _NUMERIC + " THEN trim(h->>'all') END AS n FROM gr WHERE json_type(h) = 'OBJECT')",
        "used AS (SELECT record_id, parent_pos, CASE WHEN json_type(u->'prompt_tokens') IN " + _NUMERIC + " THEN trim(u->>'prompt_tokens') END AS n FROM leaf WHERE json_type(u) = 'OBJECT')",
    ]
) + f"""
SELECT record_id, 'chain' AS child, parent_pos::INTEGER AS parent_pos, pos::INTEGER AS pos, trim(y->>'$') AS item FROM named WHERE json_type(y) IN {_NUMERIC} AND trim(y->>'$') <> ''
UNION ALL SELECT record_id, 'usage', parent_pos::INTEGER, 0::INTEGER, item FROM (SELECT *, {_WHOLE} AS item FROM used) WHERE item IS NOT NULL
UNION ALL SELECT record_id, 'group', -1::INTEGER, -1::INTEGER, label || '=' || item FROM (SELECT *, {_WHOLE} AS item FROM counts) WHERE item IS NOT NULL AND label IS NOT NULL
"""

SQL = {
    "p4_found": _P4,
    "p2_found": _KEYED + "SELECT delivery_id FROM r WHERE digest IS NOT NULL AND sample_key IS NOT NULL AND nth > 1",
    "p2_kept": _KEYED + "SELECT delivery_id, batch_id, sample_key FROM r WHERE digest IS NULL OR sample_key IS NULL OR nth = 1",
    "p4_attempt_structs": "SELECT delivery_id, attempt.usage.prompt_tokens AS prompt_tokens FROM attempts WHERE attempt.usage.prompt_tokens IS NOT NULL",
}
