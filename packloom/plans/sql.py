"""DuckDB SQL of the cleaned relations, shared by the queries' SQL."""

from __future__ import annotations


def _key(c: str) -> str:
    return rf"lower(regexp_replace({c}, '^\s+|\s+$', '', 'g'))"


def tokens(c: str) -> str:
    """Token list of a column."""
    raw = rf"regexp_extract_all(lower({c}), '[A-Za-z0-9_]+|[\x{{4e00}}-\x{{9fff}}]')"
    return f"""(SELECT list_concat(r, list_transform(list_filter(list_zip(r[1:len(r)-1], r[2:len(r)]), lambda z: length(z[1]) = 1 AND length(z[2]) = 1), lambda z: z[1] || z[2])) FROM (SELECT {raw} AS r))"""


BASE = rf"""
WITH RECURSIVE docs1 AS (
  SELECT pack, doc_code, arg_min(text, doc_id) AS text FROM documents
  WHERE pack IS NOT NULL AND doc_code IS NOT NULL AND text IS NOT NULL GROUP BY pack, doc_code),
events1 AS (
  SELECT pack, pos, event_id, coalesce(doc_id, event_id) AS doc_id, event_type, trigger_word, argument FROM case_events
  WHERE pack IS NOT NULL AND event_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY pack, event_id ORDER BY pos, coalesce(event_type, ''), coalesce(trigger_word, '')) = 1),
edges0 AS (
  SELECT pack, pos, cause_event_id AS src, coalesce(result_event_id, effect_event_id) AS dst,
         coalesce(causal_type, relation_type) AS causal_type, lower(trim(confidence_level)) AS level FROM edges),
edges1 AS (
  SELECT e.* FROM edges0 AS e SEMI JOIN events1 AS a ON a.pack = e.pack AND a.event_id = e.src
  SEMI JOIN events1 AS b ON b.pack = e.pack AND b.event_id = e.dst WHERE src <> dst),
pairs1 AS (
  SELECT pack, src, dst, level, causal_type FROM edges1
  QUALIFY row_number() OVER (PARTITION BY pack, src, dst ORDER BY pos DESC, level DESC NULLS LAST, causal_type DESC NULLS LAST) = 1),
questions1 AS (
  SELECT {_key("sample_id")} AS sample_key, pack, track, pos, lower(trim(question_type)) AS kind, question, reasoning_type FROM questions
  WHERE sample_id IS NOT NULL AND question IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {_key("sample_id")} ORDER BY pack, pos, question) = 1),
gold1 AS (
  SELECT {_key("sample_id")} AS sample_key, pack, lower(trim(question_type)) AS kind, reasoning_type,
         list_filter(coalesce(answers, []), lambda x: x IS NOT NULL) AS answers,
         list_filter(coalesce(evidence_chains, []), lambda x: x IS NOT NULL) AS chains,
         list_filter(coalesce(required_facts, []), lambda x: x IS NOT NULL) AS required,
         list_filter(coalesce(forbidden_facts, []), lambda x: x IS NOT NULL) AS forbidden,
         lower(trim(confidence_level)) AS level, causal_path FROM gold WHERE sample_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {_key("sample_id")} ORDER BY pack) = 1),
preds1 AS (
  SELECT pred_id, {_key("sample_id")} AS sample_key, pack, track, arm, answer,
         list_filter(coalesce(evidence_chain, []), lambda x: x IS NOT NULL) AS chain, confidence FROM predictions
  WHERE answer IS NOT NULL AND sample_id IS NOT NULL AND arm IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY {_key("sample_id")}, arm ORDER BY pred_id) = 1),
cand AS (
  SELECT e.pack, e.pos AS ord, e.event_id, e.doc_id, coalesce(nullif(event_type, ''), nullif(trigger_word, ''), event_id) AS label,
         event_id || ' ' || coalesce(nullif(event_type, ''), nullif(trigger_word, ''), event_id) || ' ' || coalesce(trigger_word, '') || ' '
           || left(coalesce(array_to_string(map_values(argument), '；'), ''), 450) || ' ' || left(coalesce(d.text, ''), 450) AS text
  FROM events1 AS e LEFT JOIN docs1 AS d ON d.pack = e.pack AND d.doc_code = e.doc_id
  UNION ALL
  SELECT d.pack, row_number() OVER (PARTITION BY d.pack ORDER BY doc_code) - 1, doc_code, doc_code,
         coalesce(left(regexp_replace(list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '')[1], '^[ #：:。\t]+|[ #：:。\t]+$', '', 'g'), 60), doc_code), left(text, 900)
  FROM docs1 AS d ANTI JOIN events1 AS e ON e.pack = d.pack),
ctok AS (SELECT pack, ord, event_id, {tokens("text")} AS toks FROM cand),
cstat AS (SELECT pack, count(*) AS n, CASE WHEN sum(len(toks)) = 0 THEN 1.0 ELSE avg(len(toks)) END AS avgdl FROM ctok GROUP BY pack),
ctf AS (SELECT pack, ord, event_id, dl, term, count(*) AS tf FROM (SELECT pack, ord, event_id, len(toks) AS dl, unnest(toks) AS term FROM ctok) GROUP BY ALL),
cdf AS (SELECT pack, term, count(*) AS df FROM ctf GROUP BY pack, term),
qtok AS (SELECT DISTINCT sample_key, pack, unnest(toks) AS term FROM (SELECT sample_key, pack, {tokens("question")} AS toks FROM questions1)),
bm AS (
  SELECT q.sample_key, t.pack, t.ord, t.event_id,
         sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * t.tf * 2.2 / (t.tf + 1.2 * (1 - 0.75 + 0.75 * t.dl / s.avgdl))) AS score
  FROM qtok AS q JOIN ctf AS t ON t.pack = q.pack AND t.term = q.term JOIN cdf AS d ON d.pack = t.pack AND d.term = t.term JOIN cstat AS s ON s.pack = t.pack
  GROUP BY ALL),
ranked AS (
  SELECT q.sample_key, q.pack, c.ord, c.event_id, coalesce(b.score, 0.0) AS score,
         round(coalesce(b.score / nullif(max(b.score) OVER (PARTITION BY q.sample_key), 0), 0.0), 6) AS relevance
  FROM questions1 AS q JOIN cand AS c ON c.pack = q.pack LEFT JOIN bm AS b ON b.sample_key = q.sample_key AND b.ord = c.ord AND b.event_id = c.event_id),
rank1 AS (SELECT *, row_number() OVER (PARTITION BY sample_key ORDER BY relevance DESC, ord, event_id) AS rnk FROM ranked),
anchors1 AS (
  SELECT q.sample_key, q.pack, list_filter(list_distinct_ordered, lambda x: true) AS ids FROM (
    SELECT sample_key, pack, list_transform(list_sort(list_distinct(list_transform(list_zip(ids, range(1, len(ids) + 1)), lambda z: {{'p': list_position(ids, z[1]), 'x': z[1]}}))), lambda z: z.x) AS list_distinct_ordered
    FROM (SELECT sample_key, pack, regexp_extract_all(question, 'D[0-9]{{3,}}') AS ids FROM questions1)) AS q),
known1 AS (
  SELECT a.sample_key, a.pack, list_filter(a.ids, lambda x: list_contains(coalesce(k.ids, []), x)) AS ids
  FROM anchors1 AS a LEFT JOIN (SELECT pack, list(event_id) AS ids FROM cand GROUP BY pack) AS k ON k.pack = a.pack),
paths1 AS (
  SELECT pack, [event_id] AS path FROM events1
  UNION ALL
  SELECT p.pack, list_append(p.path, e.dst) FROM paths1 AS p JOIN (SELECT DISTINCT pack, src, dst FROM edges1) AS e ON e.pack = p.pack AND e.src = p.path[-1]
  WHERE NOT list_contains(p.path, e.dst))
"""


def base(query: str, more: str = "") -> str:
    """``query`` over the cleaned relations, and over the relations that ``more`` defines from them."""
    return f"{BASE}{', ' if more else ''}{more} {query}"


def steps(c: str) -> str:
    """Neighbours of a chain as ``a>b``."""
    return f"list_transform(list_zip({c}[1:len({c})-1], {c}[2:len({c})]), lambda z: z[1] || '>' || z[2])"


def bm25(name: str, queries: str, texts: str) -> str:
    """Relations that end in ``name(query, corpus, item, score)``; ``queries(query, corpus, text)``, ``texts(corpus, item, text)``."""
    return f"""
{name}_t AS (SELECT corpus, item, {tokens("text")} AS toks FROM ({texts})),
{name}_s AS (SELECT corpus, count(*) AS n, CASE WHEN sum(len(toks)) = 0 THEN 1.0 ELSE avg(len(toks)) END AS mean FROM {name}_t GROUP BY corpus),
{name}_f AS (SELECT corpus, item, dl, term, count(*) AS tf FROM (SELECT corpus, item, len(toks) AS dl, unnest(toks) AS term FROM {name}_t) GROUP BY ALL),
{name}_d AS (SELECT corpus, term, count(*) AS df FROM {name}_f GROUP BY ALL),
{name}_q AS (SELECT DISTINCT query, corpus, unnest(toks) AS term FROM (SELECT query, corpus, {tokens("text")} AS toks FROM ({queries}))),
{name} AS (SELECT q.query, f.corpus, f.item, sum(ln(1 + (s.n - d.df + 0.5) / (d.df + 0.5)) * f.tf * 2.2 / (f.tf + 1.2 * (0.25 + 0.75 * f.dl / s.mean))) AS score
  FROM {name}_q AS q JOIN {name}_f AS f ON f.corpus = q.corpus AND f.term = q.term JOIN {name}_d AS d ON d.corpus = f.corpus AND d.term = f.term JOIN {name}_s AS s ON s.corpus = f.corpus GROUP BY ALL)"""
