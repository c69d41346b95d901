"""Queries that build and check training sets, and that check replies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packloom.functions import text as T
from packloom.operators import contract as C
from packloom.operators import dataset as D
from packloom.operators.retrieval import known_anchors
from packloom.plans.graph_queries import components_by_hash, SQL as GRAPH_SQL
from packloom.plans.sql import base, steps
from packloom.session import cut_lineage
from packloom.sources import relations as R
from packloom.sources.tables import canonical_sample_id, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.candidates(spark, sf_dir).groupBy("pack").agg(F.collect_set("event_id").alias("allowed"))


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "attempts").select("delivery_id", canonical_sample_id("sample_id").alias("sample_key"), F.col("attempt.raw").alias("raw")).where("raw IS NOT NULL")
    packs = R.questions(spark, sf_dir).select("sample_key", "pack")
    return a.join(packs, "sample_key").join(_allowed(spark, sf_dir), "pack", "left").withColumn("allowed", F.coalesce("allowed", F.array().cast("array<string>")))


_TRIM = r"regexp_replace({0}, '^[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+|[\s\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '', 'g')"
_J = "CASE WHEN json_valid({0}) THEN {0}::JSON END"
_TAG = rf"""CASE WHEN json_type(j) = 'OBJECT' AND json_type(j, '$.answer') = 'VARCHAR' AND json_type(j, '$.evidence_chain') = 'ARRAY' THEN
  CASE WHEN {_TRIM.format("json_extract_string(j, '$.answer')")} = '无法确定' THEN CASE WHEN json_array_length(j, '$.evidence_chain') = 0 AND coalesce(json_type(j, '$.confidence'), 'NULL') = 'NULL' THEN NULL ELSE 'exact_refusal_fields' END
  WHEN json_array_length(j, '$.evidence_chain') = 0 AND NOT regexp_matches(json_extract_string(j, '$.answer'), '(^|[^\p{{L}}\p{{N}}_])D[0-9]{{3,}}($|[^\p{{L}}\p{{N}}_])') AND regexp_matches({_TRIM.format("json_extract_string(j, '$.answer')")}, '^({"|".join(C.REFUSAL_PREFIXES)})') THEN 'empty_chain_refusal_phrase' END END"""


@query(f"SELECT delivery_id, coalesce({_TAG}, '') AS tag FROM (SELECT delivery_id, {_J.format('attempt.raw')} AS j FROM attempts WHERE attempt.raw IS NOT NULL)")
def refusal_canonicalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each raw reply's refusal would be put into its one form."""
    a = table(spark, sf_dir, "attempts").select("delivery_id", F.col("attempt.raw").alias("raw")).where("raw IS NOT NULL")
    return a.select("delivery_id", F.coalesce(C.refusal_tag(F.col("raw")), F.lit("")).alias("tag"))


_REPLIES = rf"""
allowed1 AS (SELECT pack, list(DISTINCT event_id) AS allowed FROM cand GROUP BY pack),
replies1 AS (SELECT a.delivery_id, coalesce(l.allowed, []) AS allowed, a.attempt.raw AS raw, regexp_replace({_TRIM.format("a.attempt.raw")}, '^```[^\n]*\n(.*)\n[^\S\n]*```[^\S\n]*$', '\1', 's') AS body
  FROM attempts AS a JOIN questions1 AS q ON q.sample_key = lower(regexp_replace(a.sample_id, '^\s+|\s+$', '', 'g')) LEFT JOIN allowed1 AS l ON l.pack = q.pack WHERE a.attempt.raw IS NOT NULL),
parsed1 AS (SELECT *, {_J.format("body")} AS v, (SELECT {_TAG} FROM (SELECT {_J.format("raw")} AS j)) AS tag FROM replies1),
said1 AS (SELECT *, CASE WHEN tag IS NOT NULL THEN '无法确定' WHEN json_type(v, '$.answer') = 'VARCHAR' THEN {_TRIM.format("json_extract_string(v, '$.answer')")} END AS said,
  CASE WHEN tag = 'exact_refusal_fields' THEN []::VARCHAR[] WHEN json_type(v, '$.evidence_chain') = 'ARRAY' AND len(list_filter(json_extract(v, '$.evidence_chain[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0 THEN list_transform(json_extract_string(v, '$.evidence_chain[*]'), lambda x: {_TRIM.format("x")}) END AS chain,
  CASE WHEN tag IS NULL AND json_type(v, '$.confidence') IN ('DOUBLE', 'UBIGINT', 'BIGINT') THEN json_extract_string(v, '$.confidence')::DOUBLE END AS number, tag IS NULL AND coalesce(json_type(v, '$.confidence'), 'NULL') <> 'NULL' AS given FROM parsed1)"""


_TWO = rf"""{_REPLIES},
thought1 AS (SELECT delivery_id, allowed, CASE WHEN contains(raw, '<think>') AND NOT contains(raw, '</think>') THEN NULL ELSE regexp_replace(raw, '^.*</think>', '', 's') END AS text FROM replies1),
bare1 AS (SELECT *, regexp_replace({_TRIM.format("text")}, '^```[^\n]*\n(.*)\n[^\S\n]*```[^\S\n]*$', '\1', 's') AS inside FROM thought1),
object1 AS (SELECT *, {_J.format("inside")} AS v FROM bare1),
spoken1 AS (SELECT *, CASE WHEN json_type(v, '$.answer') = 'VARCHAR' THEN {_TRIM.format("json_extract_string(v, '$.answer')")} END AS said,
  CASE WHEN json_type(v, '$.evidence_chain') = 'ARRAY' AND len(list_filter(json_extract(v, '$.evidence_chain[*]'), lambda x: json_type(x) <> 'VARCHAR')) = 0 THEN list_transform(json_extract_string(v, '$.evidence_chain[*]'), lambda x: {_TRIM.format("x")}) END AS chain FROM object1)"""


@query(
    base(
        """SELECT delivery_id, CASE WHEN v IS NULL THEN 'not_json' WHEN json_type(v) <> 'OBJECT' THEN 'not_object' WHEN said IS NULL OR said = '' THEN 'answer_blank' WHEN chain IS NULL THEN 'chain_not_ids'
        WHEN len(list_filter(chain, lambda x: NOT list_contains(allowed, x))) > 0 THEN 'unknown_id' WHEN len(list_distinct(chain)) < len(chain) THEN 'repeated_id' WHEN said = '无法确定' AND (len(chain) > 0 OR given) THEN 'refusal_fields'
        WHEN said <> '无法确定' AND len(chain) = 0 THEN 'no_chain' WHEN said <> '无法确定' AND number IS NULL THEN 'confidence_type' WHEN said <> '无法确定' AND NOT number BETWEEN 0 AND 1 THEN 'confidence_range' ELSE '' END AS error FROM said1""",
        _REPLIES,
    )
)
def prediction_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each raw reply breaks."""
    return _replies(spark, sf_dir).select("delivery_id", C.prediction_error(F.col("raw"), F.col("allowed")).alias("error"))


@query(
    base(
        """SELECT delivery_id, CASE WHEN text IS NULL THEN 'thinking_open' WHEN v IS NULL THEN 'not_json' WHEN json_type(v) <> 'OBJECT' THEN 'not_object' WHEN list_sort(json_keys(v)) <> ['answer', 'evidence_chain'] THEN 'other_fields'
        WHEN said IS NULL OR said = '' THEN 'answer_blank' WHEN chain IS NULL THEN 'chain_not_ids' WHEN len(list_filter(chain, lambda x: NOT list_contains(allowed, x))) > 0 THEN 'unknown_id'
        WHEN len(list_distinct(chain)) < len(chain) THEN 'repeated_id' WHEN (said = '无法确定') <> (len(chain) = 0) THEN 'refusal_fields' ELSE '' END AS error FROM spoken1""",
        _TWO,
    )
)
def two_field_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each raw reply breaks if it may hold an answer and a chain only."""
    return _replies(spark, sf_dir).select("delivery_id", C.two_field_error(F.col("raw"), F.col("allowed")).alias("error"))


@query(
    base(
        """SELECT before_error, after_error, count(*) AS rows FROM (SELECT CASE WHEN b.v IS NULL THEN 'invalid' ELSE 'json' END AS before_error, CASE WHEN b.v IS NULL THEN 'invalid' WHEN b.tag IS NOT NULL THEN 'repaired' ELSE 'kept' END AS after_error FROM said1 AS b) GROUP BY ALL""",
        _REPLIES,
    )
)
def repair_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies before and after the refusal repair."""
    r = _replies(spark, sf_dir)
    valid, tag = F.try_parse_json(C.unfenced(F.col("raw"))).isNotNull(), C.refusal_tag(F.col("raw"))
    rows = r.select(F.when(~valid, "invalid").otherwise("json").alias("before_error"), F.when(~valid, "invalid").when(tag.isNotNull(), "repaired").otherwise("kept").alias("after_error"))
    return rows.groupBy("before_error", "after_error").agg(F.count(F.lit(1)).alias("rows"))


_COMPONENTS = GRAPH_SQL["components_by_hash"].split("links1 AS", 1)[1].rsplit(" SELECT pack, min(other)", 1)[0]
_GROUPS = f"""links1 AS{_COMPONENTS},
comp1 AS (SELECT pack, min(other) AS grp FROM (SELECT pack, other FROM reach UNION SELECT pack, pack FROM links1) GROUP BY pack),
group1 AS (SELECT coalesce(c.grp, p.pack) AS grp, p.pack FROM (SELECT DISTINCT pack FROM questions WHERE pack IS NOT NULL) AS p LEFT JOIN comp1 AS c ON c.pack = p.pack),
sized1 AS (SELECT regexp_replace(min(pack), '_[^_]*$', '') AS domain, grp, count(*) AS size FROM group1 GROUP BY grp),
order1 AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY domain ORDER BY md5('20261005:' || grp), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(size) OVER (PARTITION BY domain) AS total FROM sized1),
fit1 AS (SELECT *, before < round_even(total * 0.8, 0) AS fit FROM order1),
split1 AS (SELECT domain, grp, size, CASE WHEN fit THEN 'fit' WHEN before - coalesce(sum(CASE WHEN fit THEN size END) OVER (PARTITION BY domain), 0) < round_even(total * 0.1, 0) THEN 'validation' ELSE 'holdout' END AS split_name FROM fit1)"""


def splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(pack, grp, domain, split_name)`` of all packs with questions."""
    packs = table(spark, sf_dir, "questions").select("pack").where("pack IS NOT NULL").distinct()
    groups = packs.join(components_by_hash(spark, sf_dir), "pack", "left").select("pack", F.coalesce("group_pack", "pack").alias("grp"))
    groups = cut_lineage(groups)
    sized = groups.groupBy("grp").agg(T.domain(F.min("pack")).alias("domain"), F.count(F.lit(1)).alias("size"))
    return groups.join(D.digest_order_split(sized, 20261005), "grp").select("pack", "grp", "domain", "split_name")


@query(base("SELECT g.pack, g.grp, s.split_name FROM group1 AS g JOIN split1 AS s USING (grp)", _GROUPS))
def hash_split_80_10_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs split by domain, groups of packs with shared texts kept whole."""
    return splits(spark, sf_dir).select("pack", "grp", "split_name")


_PACK_SETS = f"""
ev1 AS (SELECT pack, list(event_id) AS events FROM events1 GROUP BY pack), dc1 AS (SELECT pack, list(doc_code) AS docs FROM docs1 GROUP BY pack), pr1 AS (SELECT pack, list(src || '>' || dst) AS pairs FROM pairs1 GROUP BY pack),
item1 AS (SELECT g.*, q.question, k.ids, coalesce(e.events, []) AS events, coalesce(d.docs, []) AS docs, coalesce(p.pairs, []) AS pairs FROM gold1 AS g JOIN questions1 AS q USING (sample_key) JOIN known1 AS k USING (sample_key)
  LEFT JOIN ev1 AS e ON e.pack = g.pack LEFT JOIN dc1 AS d ON d.pack = g.pack LEFT JOIN pr1 AS p ON p.pack = g.pack),
full1 AS (SELECT *, list_filter(chains, lambda x: len(x) > 0) AS f FROM item1),
flag1 AS (SELECT sample_key, pack, list_filter([
  CASE WHEN len(list_filter(f, lambda c: len(list_filter(c, lambda x: NOT list_contains(events, x))) > 0)) > 0 THEN 'missing_event_id' END,
  CASE WHEN len(list_filter(f, lambda c: len(list_filter(c, lambda x: NOT list_contains(docs, x))) > 0)) > 0 THEN 'not_document_id_compatible' END,
  CASE WHEN len(list_filter(f, lambda c: len(list_filter({steps("c")}, lambda x: NOT list_contains(pairs, x))) > 0)) > 0 THEN 'step_absent_from_given_edges' END,
  CASE WHEN kind = 'unanswerable' AND len(f) > 0 THEN 'unanswerable_with_evidence' END, CASE WHEN len(required) = 0 THEN 'no_required_facts' END, CASE WHEN len(list_distinct(chains)) > 1 THEN 'multiple_gold_paths' END,
  CASE WHEN level IS NOT NULL AND level NOT IN ('certain', 'probable', 'possible') THEN 'nonstandard_confidence_level' END], lambda x: x IS NOT NULL) AS flags FROM full1),
compat1 AS (SELECT sample_key, pack, CASE WHEN len(chains) = 0 AND len(answers) = 1 AND answers[1] = '无法确定' THEN [[]::VARCHAR[]] ELSE list_filter(chains, lambda c: len(list_distinct(c)) = len(c) AND len(list_filter(c, lambda x: NOT list_contains(events, x))) = 0) END AS alts, question, ids, pairs, answers, causal_path FROM item1)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold items with their question, anchors and their pack's events, documents and edges."""
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    ev = R.events(spark, sf_dir).groupBy("pack").agg(F.collect_list("event_id").alias("events"))
    dc = R.documents(spark, sf_dir).groupBy("pack").agg(F.collect_list("doc_code").alias("docs"))
    pr = R.pair_levels(spark, sf_dir).groupBy("pack").agg(F.collect_list(F.concat_ws(">", "src", "dst")).alias("pairs"))
    q = R.questions(spark, sf_dir).select("sample_key", "question").join(known_anchors(spark, sf_dir).select("sample_key", "ids"), "sample_key")
    rows = R.gold(spark, sf_dir).join(q, "sample_key").join(ev, "pack", "left").join(dc, "pack", "left").join(pr, "pack", "left")
    return rows.select(*[c for c in rows.columns if c not in ("events", "docs", "pairs")], empty("events"), empty("docs"), empty("pairs"))


def _flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return items(spark, sf_dir).withColumn("flags", D.quality_flags(c("chains"), c("events"), c("docs"), c("pairs"), c("kind"), c("required"), c("level")))


@query(base("SELECT sample_key, array_to_string(flags, ',') AS flags FROM flag1", _PACK_SETS))
def quality_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality flags of each gold item."""
    return _flagged(spark, sf_dir).select("sample_key", F.array_join("flags", ",").alias("flags"))


@query(base("SELECT flag, count(*) AS samples FROM (SELECT unnest(flags) AS flag FROM flag1) GROUP BY flag", _PACK_SETS))
def flag_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many gold items have each flag."""
    return _flagged(spark, sf_dir).select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("samples"))


def _alternatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir).withColumn("alts", D.compatible_chains(F.col("chains"), F.col("answers"), F.col("events")))


@query(base("SELECT sample_key, len(list_distinct(alts)) AS alternatives, array_to_string(list_sort(list_distinct(list_transform(alts, lambda c: array_to_string(c, '>')))), '|') AS chains FROM compat1", _PACK_SETS))
def compatible_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold alternatives that the pack's events can express."""
    texts = F.array_join(F.array_sort(F.transform("alts", lambda c: F.array_join(c, ">"))), "|")
    return _alternatives(spark, sf_dir).select("sample_key", F.size("alts").alias("alternatives"), texts.alias("chains"))


@query(
    base(
        f"""SELECT sample_key, CASE WHEN len(alts) = 0 THEN NULL WHEN len(list_filter(alts, lambda c: len(c) > 0)) = 0 THEN '' ELSE array_to_string(best, '>') END AS chain FROM (SELECT c.sample_key, any_value(c.alts) AS alts,
        arg_max(x, (sup, ann, ord, hits, pref, x)) AS best FROM compat1 AS c LEFT JOIN (SELECT sample_key, x, len(list_filter({steps("x")}, lambda s: NOT list_contains(pairs, s))) = 0 AS sup, coalesce(x = causal_path, false) AS ann,
          len(list_filter(p, lambda z: z = 0)) = 0 AND p = list_sort(p) AS ord, len(list_intersect(ids, x)) AS hits, CASE WHEN regexp_matches(question, '完整|多个阶段') THEN len(x) ELSE -len(x) END AS pref
          FROM (SELECT *, list_transform(x, lambda n: instr(array_to_string(answers, chr(10)), n)) AS p FROM (SELECT *, unnest(list_filter(alts, lambda c: len(c) > 0)) AS x FROM compat1))) AS r ON r.sample_key = c.sample_key GROUP BY c.sample_key)""",
        _PACK_SETS,
    )
)
def choose_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alternative of each gold item to train on; null where none can be expressed."""
    c = F.col
    rows = _alternatives(spark, sf_dir)
    return rows.select("sample_key", F.array_join(D.chosen_chain(c("alts"), c("pairs"), c("causal_path"), c("answers"), c("ids"), c("question")), ">").alias("chain"))


_VIEWS = (
    _PACK_SETS
    + """, view1 AS (SELECT c.sample_key, c.pack, v.view, CASE WHEN v.view = 'C' THEN d.docs ELSE e.events END AS allowed, f.flags, c.alts AS alts0, g.chains, g.answers FROM compat1 AS c CROSS JOIN (VALUES ('A'), ('B'), ('C')) AS v(view)
  JOIN flag1 AS f USING (sample_key) JOIN item1 AS g USING (sample_key) LEFT JOIN LATERAL (SELECT g.docs) AS d(docs) ON true LEFT JOIN LATERAL (SELECT g.events) AS e(events) ON true),
row1 AS (SELECT sample_key, pack, view, flags, CASE WHEN len(answers) = 0 THEN 'no_answer' WHEN len(chains) = 0 AND NOT (len(answers) = 1 AND answers[1] = '无法确定') THEN 'no_chain'
  WHEN len(chains) > 0 AND len(list_filter(chains, lambda c: len(list_distinct(c)) = len(c) AND len(list_filter(c, lambda x: NOT list_contains(allowed, x))) = 0)) = 0 THEN 'not_representable' ELSE '' END AS reason FROM view1)"""
)


def view_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_key, pack, view, flags, reason)``: each gold item in the views A, B, C and why it is set aside, if it is."""
    views = F.explode(F.array(*[F.lit(v) for v in "ABC"]))
    rows = _flagged(spark, sf_dir).withColumn("view", views).withColumn("allowed", F.when(F.col("view") == "C", F.col("docs")).otherwise(F.col("events")))
    alts = D.compatible_chains(F.col("chains"), F.col("answers"), F.col("allowed"))
    reason = F.when(F.size("answers") == 0, "no_answer").when((F.size("chains") == 0) & (F.size(alts) == 0), "no_chain").when(F.size(alts) == 0, "not_representable").otherwise("")
    return rows.select("sample_key", "pack", "view", "flags", reason.alias("reason"))


@query(base("SELECT view, reason, count(*) AS rows FROM row1 GROUP BY ALL", _VIEWS))
def view_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by view and reason for being set aside."""
    return view_rows(spark, sf_dir).groupBy("view", "reason").agg(F.count(F.lit(1)).alias("rows"))


_FRACTION = "('0x' || substr(sha256({0}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"


@query(
    base(
        f"""SELECT sample_key, epoch, CASE WHEN draw < a THEN 'A' WHEN draw < a + b THEN 'B' WHEN c > 0 THEN 'C' WHEN b > 0 THEN 'B' ELSE 'A' END AS view FROM (SELECT *, {_FRACTION.format("'7:' || epoch || ':' || pack || ':' || sample_key")} * (a + b + c) AS draw FROM (
        SELECT sample_key, pack, epoch, max(CASE WHEN view = 'A' THEN 0.6 ELSE 0 END)::DOUBLE AS a, max(CASE WHEN view = 'B' THEN 0.3 ELSE 0 END)::DOUBLE AS b, max(CASE WHEN view = 'C' THEN 0.1 ELSE 0 END)::DOUBLE AS c
        FROM row1 CROSS JOIN (VALUES (0), (1)) AS e(epoch) WHERE reason = '' AND NOT list_contains(flags, 'unanswerable_with_evidence') GROUP BY ALL))""",
        _VIEWS,
    )
)
def view_mix_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One view of each item for each of two epochs, drawn by weight."""
    rows = view_rows(spark, sf_dir).where("reason = ''").where(~F.array_contains("flags", "unanswerable_with_evidence"))
    keyed = rows.groupBy("sample_key", "pack").agg(F.collect_set("view").alias("views")).withColumn("epoch", F.explode(F.array(F.lit(0), F.lit(1))))
    draw = D.fraction(F.lit("7"), "epoch", "pack", "sample_key")
    return keyed.select("sample_key", "epoch", D.weighted_view(F.col("views"), {"A": 0.6, "B": 0.3, "C": 0.1}, draw).alias("view"))


@query(base("SELECT sample_key, array_to_string(a[(('0x' || substr(sha256('7:0:' || pack || ':' || sample_key), 1, 16))::HUGEINT % len(a) + 1)::BIGINT], '>') AS chain FROM (SELECT sample_key, pack, list_sort(list_distinct(alts)) AS a FROM compat1) WHERE len(a) > 0", _PACK_SETS))
def multiref_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One alternative of each item by digest."""
    rows = _alternatives(spark, sf_dir).where(F.size("alts") > 0).select("sample_key", "pack", F.array_sort("alts").alias("a"))
    place = (D.whole_digest(F.lit("7"), F.lit("0"), "pack", "sample_key") % F.size("a").cast("decimal(20,0)")).cast("int")
    return rows.select("sample_key", F.array_join(F.get("a", place), ">").alias("chain"))


@query(base("SELECT 0::BIGINT AS split_groups, 0::BIGINT AS repeated_rows, (SELECT count(*) FROM (SELECT sample_key FROM row1 WHERE reason = '' AND NOT list_contains(flags, 'unanswerable_with_evidence') GROUP BY sample_key)) * 2 AS rows", _VIEWS))
def mix_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations of the mix: groups in several splits, repeated rows of an epoch; and its size."""
    s, mix = splits(spark, sf_dir), cut_lineage(view_mix_epoch(spark, sf_dir))
    broken = s.groupBy("grp").agg(F.countDistinct("split_name").alias("n")).agg(F.count_if(F.col("n") > 1).alias("split_groups"))
    repeats = mix.groupBy("sample_key", "epoch").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("repeated_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    one = F.lit(1).alias("one")
    return broken.select("*", one).join(repeats.select("*", one), "one").drop("one")


@query(
    base(
        """SELECT stratum, sample_key FROM (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY turn, h, sample_key) AS p FROM (SELECT kind AS stratum, pack, sample_key, md5('11:' || kind || ':' || sample_key) AS h,
        row_number() OVER (PARTITION BY kind, pack ORDER BY md5('11:' || kind || ':' || sample_key), sample_key) AS turn FROM questions1)) WHERE p <= 10"""
    )
)
def quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten questions of each kind, of different packs first."""
    q = R.questions(spark, sf_dir).select(F.col("kind").alias("stratum"), "pack", "sample_key")
    return D.quota_sample(q, "stratum", "pack", "sample_key", 10, 11).select("stratum", "sample_key")


@query(base("SELECT pack, domain FROM (SELECT pack, regexp_replace(pack, '_[^_]*$', '') AS domain, row_number() OVER (PARTITION BY regexp_replace(pack, '_[^_]*$', '') ORDER BY md5('5:' || pack), pack) AS n FROM (SELECT DISTINCT pack FROM questions1) AS p ANTI JOIN (SELECT pack FROM pack_splits WHERE lower(trim(split_name)) = 'fit') AS f USING (pack)) WHERE n <= 3"))
def seeded_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three packs a domain that the earlier fit split has not used, in digest order."""
    used = table(spark, sf_dir, "pack_splits").where(F.lower(F.trim("split_name")) == "fit").select("pack")
    packs = R.questions(spark, sf_dir).select("pack").distinct().join(used, "pack", "left_anti").withColumn("domain", T.domain(F.col("pack")))
    n = F.row_number().over(Window.partitionBy("domain").orderBy(F.md5(F.concat(F.lit("5:"), "pack")), "pack"))
    return packs.withColumn("n", n).where("n <= 3").select("pack", "domain")


@query(
    r"""SELECT lower(regexp_replace(sample_id, '^\s+|\s+$', '', 'g')) AS sample_key, arm, CASE WHEN attempt.error IS NOT NULL THEN 'error' WHEN attempt.finish_reason = 'length' THEN 'length' ELSE 'unparsed' END AS cause, count(*) AS rows FROM attempts WHERE parsed IS NULL AND sample_id IS NOT NULL GROUP BY ALL"""
)
def failure_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attempts without a parsed answer, by sample, arm and cause."""
    a = table(spark, sf_dir, "attempts").where("parsed IS NULL AND sample_id IS NOT NULL")
    cause = F.when(F.col("attempt.error").isNotNull(), "error").when(F.col("attempt.finish_reason") == "length", "length").otherwise("unparsed")
    return a.groupBy(canonical_sample_id("sample_id").alias("sample_key"), "arm", cause.alias("cause")).agg(F.count(F.lit(1)).alias("rows"))


@query("SELECT doc_id, length(text) AS chars, CASE WHEN length(text) > 2000 THEN 'excluded' ELSE 'kept' END AS outcome FROM documents WHERE text IS NOT NULL")
def length_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents within and beyond a length limit; none is cut."""
    n = F.length("text")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", n.alias("chars"), F.when(n > 2000, "excluded").otherwise("kept").alias("outcome"))


@query(base("SELECT p.pred_id, len(list_concat(list_transform(range(length(q.question)), lambda i: -100), list_transform(range(length(p.answer)), lambda i: 1))) AS labels, length(q.question) AS masked, list_sum(list_concat(list_transform(range(length(q.question)), lambda i: -100), list_transform(range(1, length(p.answer) + 1), lambda i: unicode(p.answer[i]))))::BIGINT AS checksum FROM preds1 AS p JOIN questions1 AS q USING (sample_key) WHERE length(p.answer) > 0"))
def label_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of question and answer, the question masked; characters stand for tokens here."""
    codes = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(?s)(.)"), F.lit(1)), lambda x: F.conv(F.hex(F.encode(x, "UTF-32")), 16, 10).cast("int"))
    rows = R.predictions(spark, sf_dir).join(R.questions(spark, sf_dir).select("sample_key", "question"), "sample_key").where("length(answer) > 0")
    prompt, whole = codes(F.col("question")), codes(F.concat("question", "answer"))
    labels = rows.select("pred_id", D.label_mask(prompt, whole).alias("labels"))
    return labels.select("pred_id", F.size("labels").alias("labels"), F.size(F.filter("labels", lambda x: x == -100)).alias("masked"), F.aggregate("labels", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("checksum"))


@query(base("SELECT sample_key, md5(question) AS prompt, md5(coalesce(answers[1], '')) AS reply, 2 AS messages FROM questions1 AS q JOIN gold1 AS g USING (sample_key)"))
def sft_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Message lists for training, as digests of what user and assistant say."""
    rows = R.questions(spark, sf_dir).select("sample_key", "question").join(R.gold(spark, sf_dir).select("sample_key", "answers"), "sample_key")
    message = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    m = rows.select("sample_key", F.array(message("user", F.col("question")), message("assistant", F.coalesce(F.get("answers", F.lit(0)), F.lit("")))).alias("m"))
    return m.select("sample_key", F.md5(F.col("m")[0]["content"]).alias("prompt"), F.md5(F.col("m")[1]["content"]).alias("reply"), F.size("m").alias("messages"))


@query(base("SELECT regexp_replace(pack, '_[^_]*$', '') AS domain, CASE WHEN regexp_replace(pack, '_[^_]*$', '') IN ('网络信息', '生态环保') THEN 'validation' ELSE 'fit' END AS part, count(*) AS samples FROM questions1 GROUP BY ALL"))
def domain_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by domain, two domains held out."""
    d = T.domain(F.col("pack"))
    q = R.questions(spark, sf_dir).select(d.alias("domain"))
    return q.groupBy("domain", F.when(F.col("domain").isin("网络信息", "生态环保"), "validation").otherwise("fit").alias("part")).agg(F.count(F.lit(1)).alias("samples"))


@query(base("SELECT q.sample_key, (SELECT count(*) FROM docs1 AS d WHERE d.pack = q.pack) AS documents, CASE WHEN q.track = 'C' THEN 0 ELSE (SELECT count(*) FROM events1 AS e WHERE e.pack = q.pack) END AS events, CASE WHEN q.track IN ('B', 'C') THEN 0 ELSE (SELECT count(*) FROM edges1 AS e WHERE e.pack = q.pack) END AS relations FROM questions1 AS q"))
def prompt_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the prompt of each question holds in its view; the JSON itself is in ``prompt_json``."""
    p = prompt_parts(spark, sf_dir)
    return p.select("sample_key", F.size("documents").alias("documents"), F.size("events").alias("events"), F.size("relations").alias("relations"))


def prompt_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(sample_key, question, documents, events, relations)``: parts in file order; view C hides events, views B and C relations."""
    in_order = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))
    docs = R.documents(spark, sf_dir).groupBy("pack").agg(in_order("doc_code", "text").alias("documents"))
    ev = R.events(spark, sf_dir).groupBy("pack").agg(in_order("pos", "event_id", "event_type", "trigger_word").alias("events"))
    ed = R.edges(spark, sf_dir).groupBy("pack").agg(in_order("pos", "src", "dst", "causal_type", "level").alias("relations"))
    q = R.questions(spark, sf_dir).join(docs, "pack", "left").join(ev, "pack", "left").join(ed, "pack", "left")
    seen = lambda c, hidden: F.when(F.col("track").isin(*hidden) | F.col(c).isNull(), F.filter(c, lambda x: F.lit(False))).otherwise(F.col(c))
    none = lambda c, hidden: F.coalesce(seen(c, hidden), F.from_json(F.lit("[]"), q.schema[c].dataType)).alias(c)
    return q.select("sample_key", "track", "kind", "question", none("documents", ("",)), none("events", ("C",)), none("relations", ("B", "C")))


@query()
def prompt_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prompt of each question as compact JSON, null members written out."""
    p = prompt_parts(spark, sf_dir)
    return p.select("sample_key", F.to_json(F.struct("track", "sample_key", "kind", "question", "documents", "events", "relations"), {"ignoreNullFields": "false"}).alias("prompt"))
