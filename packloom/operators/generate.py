"""Generators behind one interface, in stages: ask, check by the contracts' column rules, ask again, route, review, rewrite.

A generator is any picklable ``(prompt, limit) -> text``; calling a hosted model is the caller's business. Every stage's
replies are written to the checkpoint folder before they are looked at, so no model is asked twice for the same stage.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packloom.operators import contract as C
from packloom.operators.graph import chain_candidates
from packloom.session import cut_lineage

Model = Callable[[str, int], str]
MOST_LIMIT = 32_768


def called(df: DataFrame, prompt: Column, model: Model, limit: Column) -> DataFrame:
    """``df`` with ``raw``, the model's reply to each row's prompt, and ``failure``, the exception it raised instead.

    Partitions run in parallel, rows of one go one after the other. A null prompt is not asked.
    """
    kept = df.drop("raw", "failure")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema.fields)}, raw string, failure string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, failure = [], []
            for ask, most in zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True):
                said = failed = None
                if ask is not None:
                    try:
                        said = model(ask, most)
                    except Exception as e:  # noqa: BLE001 (whatever the model raises is this row's error)
                        failed = f"model: {type(e).__name__}"
                raw.append(said)
                failure.append(failed)
            rows = b.select(range(b.num_columns - 2))
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(raw, pa.string()), pa.array(failure, pa.string())], names=[*rows.schema.names, "raw", "failure"])

    return cut_lineage(kept.select("*", prompt.alias("__ask"), limit.cast("int").alias("__most")).mapInArrow(run, schema))


def _ids(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def generate(prompts: DataFrame, model: Model, rounds: int = 2, limit: int = 2048) -> DataFrame:
    """Replies to ``prompts(sample_key, prompt, allowed)``, checked: ``(sample_key, raw, rounds, error, answer, evidence_chain, confidence)``, one row a prompt.

    A reply that breaks a rule is asked for again with the rule's name and twice the length limit (at most MOST_LIMIT); after
    ``rounds`` the row becomes a refusal with the last error. An exception of the model counts as an error of the round.
    """
    left = prompts.select("sample_key", "prompt", _ids(F.col("allowed")).alias("allowed"), F.col("prompt").alias("ask"), F.lit(limit).alias("most"))
    done = []
    for n in range(1, rounds + 1):
        error = F.coalesce(F.col("failure"), F.when(F.col("raw").isNull(), "not_json"), C.prediction_error(F.col("raw"), F.col("allowed")))
        replies = called(left, F.col("ask"), model, F.col("most")).withColumn("error", error).withColumn("rounds", F.lit(n))
        done.append(replies.where("error = ''" if n < rounds else "true"))
        left = replies.where("error <> ''").select("sample_key", "prompt", "allowed", F.concat_ws("\n", "prompt", "error").alias("ask"), F.least(2 * F.col("most"), F.lit(MOST_LIMIT)).alias("most"))
    every = done[0]
    for x in done[1:]:
        every = every.unionByName(x)
    return _held(every)


def _held(replies: DataFrame) -> DataFrame:
    """The contents of replies with an empty error; of others the refusal."""
    rows = replies.withColumn("c", F.when(F.col("error") == "", C.content(F.col("raw"))))
    return rows.select(
        "sample_key", "raw", "rounds", "error",
        F.coalesce("c.answer", F.lit(C.REFUSAL)).alias("answer"), _ids(F.col("c.chain")).alias("evidence_chain"), F.col("c.confidence").alias("confidence"),
    )


def routed(drafts: DataFrame, router: Model, reviewer: Model, limits: tuple[int, int] = (4096, 8192)) -> DataFrame:
    """Two stages: a route for each draft, then a review of it among candidate chains: ``(sample_key, decision, route, candidates, answer, evidence_chain, confidence)``.

    ``drafts(sample_key, prompt, allowed, links, answer, chain)``; ``links`` are the pack's two-event arrays, ``answer`` and
    ``chain`` the draft (null without one). ``decision``: ``route_invalid`` (no usable route: no answer), ``consensus`` (route and
    draft both refuse: no second stage), ``reviewed`` or ``review_invalid`` (no answer).
    """
    keep = ["sample_key", "prompt", "allowed", "links", "answer", "chain"]
    d = drafts.select("sample_key", "prompt", _ids(F.col("allowed")).alias("allowed"), F.coalesce("links", F.array().cast("array<array<string>>")).alias("links"), "answer", _ids(F.col("chain")).alias("chain"))
    draft = F.to_json(F.struct("answer", F.col("chain").alias("evidence_chain")))
    first = called(d, F.concat_ws("\n", "prompt", F.lit("draft:"), draft), router, F.lit(limits[0]))
    broken = F.coalesce(F.col("failure"), F.when(F.col("raw").isNull(), "not_json"), C.route_error(F.col("raw"), F.col("allowed")))
    v = F.try_parse_json("raw")
    basis = F.try_variant_get(v, "$.basis_ids", "array<string>")
    staged = first.select(*keep, broken.alias("broken"), F.try_variant_get(v, "$.route", "string").alias("route"), _ids(basis).alias("basis"))
    step = F.when(F.col("broken") != "", "route_invalid").when((F.col("route") == "strict_refusal") & (F.col("answer") == C.REFUSAL), "consensus").otherwise("review")
    staged = staged.withColumn("step", step).withColumn("candidates", F.when(F.col("step") == "review", chain_candidates(F.col("chain"), F.col("basis"), F.col("links"))))
    asked = F.when(F.col("step") == "review", F.concat_ws("\n", "prompt", F.lit("draft:"), draft, F.lit("route:"), F.col("route"), F.lit("candidates:"), F.to_json("candidates")))
    second = called(staged, asked, reviewer, F.lit(limits[1]))
    error = F.when(F.col("step") == "review", F.coalesce(F.col("failure"), F.when(F.col("raw").isNull(), "not_json"), C.prediction_error(F.col("raw"), F.col("allowed"))))
    rows = second.withColumn("error", error).withColumn("c", F.when(F.col("error") == "", C.content(F.col("raw"))))
    consensus = F.col("step") == "consensus"
    return rows.select(
        "sample_key",
        F.when(F.col("step") != "review", F.col("step")).when(F.col("error") == "", "reviewed").otherwise("review_invalid").alias("decision"),
        F.when(F.col("broken") == "", F.col("route")).alias("route"),
        "candidates",
        F.when(consensus, F.lit(C.REFUSAL)).otherwise(F.col("c.answer")).alias("answer"),
        F.when(consensus, F.array().cast("array<string>")).otherwise(F.col("c.chain")).alias("evidence_chain"),
        F.col("c.confidence").alias("confidence"),
    )


def rewritten(drafts: DataFrame, model: Model, limit: int = 4096) -> DataFrame:
    """Answers written anew for a chain that stays as it is: ``(sample_key, outcome, answer, evidence_chain, confidence)``.

    ``drafts(sample_key, prompt, answer, chain, confidence)``. ``outcome``: ``refusal`` (not asked), ``rewritten``, or ``kept``
    where the reply is no object with a text ``answer``, or is blank or a refusal.
    """
    d = drafts.select("sample_key", "prompt", "answer", _ids(F.col("chain")).alias("chain"), "confidence")
    ask = F.when(F.col("answer") != C.REFUSAL, F.concat_ws("\n", "prompt", F.lit("locked chain:"), F.to_json("chain"), F.lit("draft:"), F.col("answer")))
    said = C.stripped(F.try_variant_get(F.try_parse_json(C.unfenced(F.col("raw"))), "$.answer", "string"))
    rows = called(d, ask, model, F.lit(limit)).withColumn("said", F.when(C.kind(C.member(F.try_parse_json(C.unfenced(F.col("raw"))), "answer")) == "TEXT", said))
    good = F.coalesce((F.col("said") != "") & (F.col("said") != C.REFUSAL), F.lit(False))
    outcome = F.when(F.coalesce(F.col("answer") == C.REFUSAL, F.lit(False)), "refusal").when(good, "rewritten").otherwise("kept")
    return rows.select("sample_key", outcome.alias("outcome"), F.when(outcome == "rewritten", F.col("said")).otherwise(F.col("answer")).alias("answer"), F.col("chain").alias("evidence_chain"), "confidence")


_ID = re.compile(r"D[0-9]{3,}")


def mock_model(prompt: str, limit: int) -> str:
    """A deterministic stand-in, by the prompt's digest: an answer with the first event named, a refusal, or a reply that breaks a rule.

    Asked again with an error's name it answers properly, or refuses where no event is named.
    """
    ids, turn = _ID.findall(prompt), hashlib.md5(prompt.encode("utf-8", "replace")).digest()[0] % 4
    again = prompt.rpartition("\n")[2] in ("not_json", "unknown_id", "confidence_range")
    if turn == 0 and not again:
        return "{"
    if not ids or (turn == 1 and not again):
        return json.dumps({"answer": C.REFUSAL, "evidence_chain": [], "confidence": None}, ensure_ascii=False)
    return json.dumps({"answer": f"{ids[0]}。", "evidence_chain": ids[:1], "confidence": 2 if turn == 2 and not again else 0.5}, ensure_ascii=False)


def mock_router(prompt: str, limit: int) -> str:
    """A stand-in for the first stage: refuses where no event is named, routes to an answer otherwise, and breaks off at times."""
    ids, turn = _ID.findall(prompt), hashlib.md5(prompt.encode("utf-8", "replace")).digest()[0] % 8
    if turn == 0:
        return '{"route": '
    mode = {"route": "answer", "evidence_mode": "anchor", "basis_ids": ids[:1]} if ids else {"route": "strict_refusal", "evidence_mode": "none", "basis_ids": []}
    return json.dumps({**mode, "requested_target": "event", "reason": ""})
