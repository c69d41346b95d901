"""Checks of generated replies: what a reply must hold, told as a code for each row instead of an exception."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packloom.functions.text import let

# Beginnings of a pure refusal, and the refusal's one form.
REFUSAL = "无法确定"
REFUSAL_PREFIXES = [
    "无法回答",
    "不能确定",
    "不能得出唯一确定结论",
    "无法精确确定",
    "不能精确确定",
    "无法精确量化",
    "不能精确量化",
    "现有材料不足以确定",
    "材料不足以确定",
    "证据不足以确定",
]
ROUTES, MODES = ["strict_refusal", "limited_explanation", "answer"], ["none", "anchor", "path"]
BLANKS = r"(?U)^\s+|\s+$"


def stripped(c: Column) -> Column:
    """Text without blanks of any script around it."""
    return F.regexp_replace(c, BLANKS, "")


def member(value: Column, name: str) -> Column:
    """A member of a JSON object (VARIANT), null if it is missing."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def kind(value: Column) -> Column:
    """TEXT, NUMBER, BOOLEAN, LIST, OBJECT or NULL (missing or null) for a VARIANT."""

    def name(s: Column) -> Column:
        return (
            F.when(s.isNull() | (s == "VOID"), "NULL")
            .when(s == "STRING", "TEXT")
            .when(s == "BOOLEAN", "BOOLEAN")
            .when(s.startswith("ARRAY"), "LIST")
            .when(s.startswith("OBJECT"), "OBJECT")
            .otherwise("NUMBER")
        )

    return let(F.schema_of_variant(value), name)


def texts(value: Column) -> Column:
    """A list of texts (VARIANT) as an array; null if it is no list, or holds anything but texts."""

    def listed(s: Column) -> Column:
        as_texts = F.try_variant_get(value, "$", "array<string>")
        return F.when(s == "ARRAY<VOID>", F.when(F.size(F.try_variant_get(value, "$", "array<variant>")) == 0, F.array().cast("array<string>"))).when(
            s == "ARRAY<STRING>", let(as_texts, lambda t: F.when(~F.exists(t, lambda x: x.isNull()), t))
        )

    return let(F.schema_of_variant(value), listed)


def reply(text: Column) -> Column:
    """What a reply's JSON holds, read once: kinds of its members, the answer, the chain and the confidence; ``kind`` is null for broken JSON."""

    def fields(v: Column) -> Column:
        def members(m: Column) -> Column:
            said = F.when(m["answer_kind"] == "TEXT", F.try_variant_get(v, "$.answer", "string"))
            return F.struct(
                m["kind"].alias("kind"),
                stripped(said).alias("answer"),
                m["chain_kind"].alias("chain_kind"),
                F.when(m["chain_kind"] == "LIST", F.size(F.try_variant_get(v, "$.evidence_chain", "array<variant>"))).alias("chain_size"),
                F.when(m["chain_kind"] == "LIST", F.transform(texts(member(v, "evidence_chain")), stripped)).alias("chain"),
                m["confidence_kind"].alias("confidence_kind"),
                F.when(m["confidence_kind"] == "NUMBER", F.try_variant_get(v, "$.confidence", "double")).alias("confidence"),
            )

        kinds = F.struct(kind(v).alias("kind"), *[kind(member(v, n)).alias(f"{a}_kind") for n, a in (("answer", "answer"), ("evidence_chain", "chain"), ("confidence", "confidence"))])
        return F.when(v.isNotNull(), let(kinds, members))

    return let(F.try_parse_json(text), fields)


def unfenced(raw: Column) -> Column:
    """A reply without the code fence that may enclose it."""
    return F.regexp_replace(stripped(raw), r"(?s)^```[^\n]*\n(.*)\n[^\S\n]*```[^\S\n]*$", "$1")


def after_thinking(raw: Column) -> Column:
    """What follows a complete ``<think>`` part; null where such a part is not closed."""
    return F.when(F.contains(raw, F.lit("<think>")) & ~F.contains(raw, F.lit("</think>")), None).otherwise(F.regexp_replace(raw, "(?s)^.*</think>", ""))


def refusal_tag(raw: Column) -> Column:
    """How a reply's refusal would be put into its one form: ``exact_refusal_fields``, ``empty_chain_refusal_phrase`` or null.

    Broken JSON, other values than objects and real answers are left alone. A phrase counts only with an empty chain and without an id.
    """
    return let(reply(raw), _tag)


def _tag(r: Column) -> Column:
    said, empty = r["answer"], r["chain_size"] == 0
    exact = F.when(~(empty & (r["confidence_kind"] == "NULL")), "exact_refusal_fields")
    no_id = ~said.rlike(r"(?<![\p{L}\p{N}_])D[0-9]{3,}(?![\p{L}\p{N}_])")
    phrase = F.when(empty & said.rlike("^(?:" + "|".join(REFUSAL_PREFIXES) + ")") & no_id, "empty_chain_refusal_phrase")
    return F.when((r["kind"] == "OBJECT") & said.isNotNull() & (r["chain_kind"] == "LIST"), F.when(said == REFUSAL, exact).otherwise(phrase))


def _rules(p: Column) -> Column:
    r, tag = p["r"], p["tag"]
    return F.struct(
        r["kind"].alias("kind"),
        F.when(tag.isNotNull(), F.lit(REFUSAL)).otherwise(r["answer"]).alias("said"),
        F.when(tag == "exact_refusal_fields", F.array().cast("array<string>")).otherwise(r["chain"]).alias("chain"),
        F.when(tag.isNull(), r["confidence"]).alias("number"),
        (tag.isNull() & (r["confidence_kind"] != "NULL")).alias("given"),
    )


def _read(raw: Column) -> Column:
    # A reply that is bare JSON is read once; the repair looks at the reply as it came.
    fenced = F.startswith(stripped(raw), F.lit("```"))
    return let(reply(raw), lambda r: F.struct(F.when(fenced, reply(unfenced(raw))).otherwise(r).alias("r"), _tag(r).alias("tag")))


def content(raw: Column) -> Column:
    """A reply's answer, chain and confidence, clear refusals in their one form: a struct ``(answer, chain, confidence)``."""
    return let(_read(raw), lambda p: let(_rules(p), lambda x: F.struct(x["said"].alias("answer"), x["chain"].alias("chain"), x["number"].alias("confidence"))))


def prediction_error(raw: Column, allowed: Column) -> Column:
    """The first rule that a reply breaks, or the empty text: JSON object, answer, chain of known ids without repeats, refusal and confidence.

    ``allowed`` is an array of the ids the reply may name. Clear refusals are put into their one form before.
    """

    def error(x: Column) -> Column:
        said, chain, number = x["said"], x["chain"], x["number"]
        refused = said == REFUSAL
        return (
            F.when(x["kind"].isNull(), "not_json")
            .when(x["kind"] != "OBJECT", "not_object")
            .when(said.isNull() | (said == ""), "answer_blank")
            .when(chain.isNull(), "chain_not_ids")
            .when(F.size(F.array_except(chain, allowed)) > 0, "unknown_id")
            .when(F.size(F.array_distinct(chain)) < F.size(chain), "repeated_id")
            .when(refused & ((F.size(chain) > 0) | x["given"]), "refusal_fields")
            .when(~refused & (F.size(chain) == 0), "no_chain")
            .when(~refused & number.isNull(), "confidence_type")
            .when(~refused & ~number.between(0.0, 1.0), "confidence_range")
            .otherwise("")
        )

    return let(_read(raw), lambda p: let(_rules(p), error))


def two_field_error(raw: Column, allowed: Column) -> Column:
    """Like ``prediction_error`` for replies that may think first and hold an answer and a chain, nothing else."""
    text = after_thinking(raw)

    def error(r: Column) -> Column:
        said, chain = r["answer"], r["chain"]
        return (
            F.when(text.isNull(), "thinking_open")
            .when(r["kind"].isNull(), "not_json")
            .when(r["kind"] != "OBJECT", "not_object")
            .when(F.array_sort(F.json_object_keys(unfenced(text))) != F.array(F.lit("answer"), F.lit("evidence_chain")), "other_fields")
            .when(said.isNull() | (said == ""), "answer_blank")
            .when(chain.isNull(), "chain_not_ids")
            .when(F.size(F.array_except(chain, allowed)) > 0, "unknown_id")
            .when(F.size(F.array_distinct(chain)) < F.size(chain), "repeated_id")
            .when((said == REFUSAL) != (F.size(chain) == 0), "refusal_fields")
            .otherwise("")
        )

    return let(reply(unfenced(text)), error)


def route_error(raw: Column, allowed: Column) -> Column:
    """The first rule that an answer route breaks, or the empty text."""
    v = F.try_parse_json(raw)
    text = lambda n: F.when(kind(member(v, n)) == "TEXT", F.try_variant_get(v, f"$.{n}", "string"))
    route, mode, ids = text("route"), text("evidence_mode"), texts(member(v, "basis_ids"))
    strict = route == "strict_refusal"
    return (
        F.when(v.isNull(), "not_json")
        .when(~F.coalesce(route.isin(ROUTES), F.lit(False)), "route")
        .when(~F.coalesce(mode.isin(MODES), F.lit(False)), "evidence_mode")
        .when(ids.isNull() | (F.size(F.array_except(ids, allowed)) > 0), "basis_ids")
        .when(F.size(F.array_distinct(ids)) < F.size(ids), "repeated_basis")
        .when(strict & (mode != "none"), "refusal_with_evidence")
        .when(~strict & (mode == "none"), "answer_without_evidence")
        .when(F.coalesce(stripped(text("requested_target")), F.lit("")) == "", "target")
        .when(text("reason").isNull(), "reason")
        .otherwise("")
    )


def text_or_list(value: Column) -> Column:
    """A member that may be one text or a list: an array of its texts; other values give none."""
    listed = F.try_variant_get(value, "$", "array<variant>")
    kept = F.transform(F.filter(listed, lambda x: kind(x) == "TEXT"), lambda x: F.try_variant_get(x, "$", "string"))
    return F.when(kind(value) == "TEXT", F.array(F.try_variant_get(value, "$", "string"))).when(kind(value) == "LIST", kept).otherwise(F.array().cast("array<string>"))


def facts(value: Column) -> Column:
    """Facts given as texts or as objects with ``fact`` or ``text``."""
    listed = F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))
    one = lambda x: F.when(kind(x) == "TEXT", F.try_variant_get(x, "$", "string")).when(
        kind(x) == "OBJECT", F.coalesce(F.try_variant_get(x, "$.fact", "string"), F.try_variant_get(x, "$.text", "string"), F.lit(""))
    )
    return F.filter(F.transform(listed, one), lambda x: x.isNotNull())


def endpoint_error(url: Column) -> Column:
    """Why a completion address can't be used, or the empty text: http or https, a host, no user part, no query or fragment."""
    part = lambda p: F.try_parse_url(url, F.lit(p))
    return (
        F.when(~F.coalesce(part("PROTOCOL").isin("http", "https"), F.lit(False)), "scheme")
        .when(F.coalesce(part("HOST"), F.lit("")) == "", "host")
        .when(part("USERINFO").isNotNull(), "user")
        .when(part("QUERY").isNotNull() | part("REF").isNotNull(), "query")
        .otherwise("")
    )


def redacted(text: Column, secret: Column) -> Column:
    """``text`` with a secret, and any bearer token, blotted out."""
    without = F.when(F.length(secret) > 0, F.replace(text, secret, F.lit("[redacted]"))).otherwise(text)
    return F.regexp_replace(without, r"(?i)bearer\s+[A-Za-z0-9._~+/=-]+", "Bearer [redacted]")
