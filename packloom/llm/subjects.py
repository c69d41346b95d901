"""Subjects of documents by labelling functions whose accuracies a latent model learns.

Five labelling functions look at each (document, subject): the share of sentences that a lexicon gives the subject, its
share of text in sections that treat it, the heading, the document's address (its pack's domain) and its source. A generative model with
one hidden truth for each pair learns, from the counts of all vote patterns of the corpus and without labels, how
often each function gives each vote under either truth; documents get the subjects of high posterior probability.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.operators.skew import salted_join
from packloom.session import cut_lineage

#: Labelled examples from which the lexicon is fitted; more are left aside, lowest ids first taken.
MOST_EXAMPLES = 5000
#: Examples that must hold a term, by writing, and the share of them that must have its subject.
LEAST_HAN, LEAST_OTHER, PURITY = 5, 3, 0.9
#: Upper ends of the lexicon function's levels; a fifth of the sentences lies inside the third.
LEVELS = (0.0, 0.08, 0.16, 0.28)
#: Documents get the subjects of at least this posterior probability.
CUT = 0.5
#: Names of subject areas, for the addresses; a table of more is refused.
MOST_AREAS = 1000
#: Votes of the functions heading, address and source, and of sections.
NO, YES, ABSTAIN = 0, 1, 2

_INVISIBLE = re.compile("[­​-‏⁠-⁯﻿︀-️]")
_MARKUP = re.compile(r"</?[A-Za-z][^<>]{0,200}>|\*\*")
_SENTENCE = re.compile(r"(?<=[。！？；!?;])|(?<=[.])(?=\s)")
_HAN = re.compile(r"[㐀-鿿]+")
_WORD = re.compile(r"[^\W\d_]+")
_ENDS = "。！？；!?;.:："


def clean(text: str) -> str:
    """``text`` without markup and invisible characters, in one width and case."""
    return unicodedata.normalize("NFKC", _MARKUP.sub("", _INVISIBLE.sub("", text))).casefold()


def sections(text: str) -> tuple[str | None, list[list[str]]]:
    """Heading, if the first line is one, and the sentences of each section.

    A line that neither ends a sentence nor is a heading goes on in the next one.
    """
    lines = [x.strip() for x in text.split("\n")]
    lines = [x for x in lines if x]
    heading = None
    if lines and (lines[0].startswith("#") or (len(lines) > 1 and len(lines[0]) < 80 and lines[0][-1] not in _ENDS)):
        heading = lines.pop(0)
    out, held = [], ""
    for line in lines:
        held += (" " if held and held[-1].isascii() and line[0].isascii() else "") + line
        if line[-1] in _ENDS:
            out.append(held)
            held = ""
    if held:
        out.append(held)
    split = [[s for s in _SENTENCE.split(x) if _WORD.search(s)] for x in out]
    return heading, [x for x in split if x]


def terms(sentence: str) -> set[str]:
    """Runs of two to four ideographs, and words and pairs of words between spaces."""
    out = set()
    for run in _HAN.findall(sentence):
        for n in (2, 3, 4):
            out.update(run[i : i + n] for i in range(len(run) - n + 1))
    words = [w for w in _WORD.findall(_HAN.sub(" ", sentence))]
    out.update(f" {w} " for w in words if len(w) > 3)
    out.update(f" {a} {b} " for a, b in zip(words, words[1:]))
    return out


def fit_lexicon(examples: list[tuple[str, list[str]]]) -> dict[str, int | str]:
    """Term -> the subject it stands for, from texts of a single subject."""
    have, by = Counter(), defaultdict(Counter)
    for text, subjects in examples:
        if text and subjects and len(set(subjects)) == 1:
            for t in terms(clean(text).replace("\n", " ")):
                have[t] += 1
                by[t][subjects[0]] += 1
    out = {}
    for t, n in have.items():
        subject, k = by[t].most_common(1)[0]
        if n >= (LEAST_OTHER if t[0] == " " else LEAST_HAN) and k >= PURITY * n:
            out[t] = subject
    return out


class Lexicon:
    """An automaton over a fitted lexicon."""

    def __init__(self, lexicon: dict[str, str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for t, subject in lexicon.items():
            # A longer term tells more.
            self.automaton.add_word(t, (subject, len(t.strip()) if t[0] != " " else 2 + 2 * t.strip().count(" ")))
        self.empty = not lexicon
        if lexicon:
            self.automaton.make_automaton()

    def leader(self, sentence: str) -> str | None:
        """The subject most of a sentence's terms stand for; None without terms or with a tie."""
        if self.empty:
            return None
        if not sentence.isascii():
            sentence = _HAN.sub(r" \g<0> ", sentence)
        weight: dict[str, int] = {}
        for _, (subject, w) in self.automaton.iter(f" {' '.join(_SPLIT.split(sentence))} "):
            weight[subject] = weight.get(subject, 0) + w
        if not weight:
            return None
        best = sorted(weight.values())
        if len(best) > 1 and best[-1] == best[-2]:
            return None
        return max(weight, key=weight.__getitem__)


_SPLIT = re.compile(r"[\W\d_]+")


def votes(lexicon: Lexicon, text: str, address: str | None) -> dict[str, tuple[int, int, int, int]]:
    """Subject -> votes (lexicon level, sections, heading, address) for each subject with any sign of it."""
    heading, parts = sections(clean(text))
    said: Counter = Counter()
    led: Counter = Counter()
    total = 0
    for part in parts:
        own = Counter(x for x in map(lexicon.leader, part) if x)
        total += len(part)
        said.update(own)
        led.update({s: len(part) for s, n in own.items() if n * 3 >= len(part) and (n > 1 or 2 * n >= len(part))})
    title = lexicon.leader(heading) if heading else None
    out = {}
    for s in {*said, *([title] if title else []), *([address] if address else [])} if total else ():
        share = said[s] / total
        level = sum(share > x for x in LEVELS)
        section = YES if led[s] >= 0.2 * total else NO
        out[s] = (level, section if len(parts) > 1 else ABSTAIN, ABSTAIN if title is None else int(title == s), ABSTAIN if address is None else int(address == s))
    return out


SIZES = (len(LEVELS) + 1, 3, 3, 3, 3)


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, list[np.ndarray], float]:
    """Posterior of each vote pattern, the functions' vote probabilities under both truths, and the prior, by expectation-maximisation.

    Abstentions carry no evidence. The start is the share of yes among the other functions' votes; what the lexicon's
    levels tell is learned from there.
    """
    others = patterns[:, 1:]
    said = (others == YES).sum(axis=1)
    p = (said + 0.5) / ((others != ABSTAIN).sum(axis=1) + 1)
    for _ in range(rounds):
        mass = np.stack([counts * (1 - p), counts * p])
        prior = (mass[1].sum() + 1) / (counts.sum() + 2)
        tables, odds = [], np.full(len(p), np.log(prior / (1 - prior)))
        for j, size in enumerate(SIZES):
            t = np.stack([np.bincount(patterns[:, j], weights=m, minlength=size) for m in mass]) + 0.5
            if j:
                t[:, ABSTAIN] = 0
            t = t / t.sum(axis=1, keepdims=True)
            tables.append(t)
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = np.log(t[1] / t[0])
            odds += np.where(np.isfinite(ratio), ratio, 0)[patterns[:, j]]
        new = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
        done = np.abs(new - p).max() < 1e-9
        p = new
        if done:
            break
    return p, tables, prior


VOTES = "doc_id bigint, source string, subject string, lexicon int, section int, heading int, address int"


def subject_posteriors(documents: DataFrame, examples: DataFrame, areas: DataFrame) -> DataFrame:
    """``(doc_id, subject, lexicon, posterior)`` for each subject with any sign of it in a document.

    ``documents(doc_id, text, source, pack)``, ``examples(example_id, text, subjects)``, ``areas(subject, name)``. Null and
    blank texts give no row. Null sources and packs abstain. Whole texts are read; only vote counts are shuffled, and the
    patterns' counts (at most 405 rows) and the lexicon alone reach the driver.
    """
    spark = documents.sparkSession
    labelled = examples.where("subjects IS NOT NULL AND size(subjects) > 0 AND text IS NOT NULL").orderBy("example_id").limit(MOST_EXAMPLES)
    lexicon = spark.sparkContext.broadcast(fit_lexicon([(r["text"], r["subjects"]) for r in labelled.select("text", "subjects").collect()]))
    names = areas.where("name IS NOT NULL AND subject IS NOT NULL").select("name", "subject").distinct().orderBy("name", "subject").limit(MOST_AREAS + 1).collect()
    if len(names) > MOST_AREAS:
        raise ValueError(f"more than {MOST_AREAS} subject areas")
    domains = {r["name"]: r["subject"] for r in names}

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Lexicon(lexicon.value)
        for b in batches:
            rows = []
            for doc, text, source, pack in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if text:
                    address = domains.get(pack.rpartition("_")[0]) if pack else None
                    rows += [(doc, source, s, *v) for s, v in votes(own, text, address).items()]
            names = [x.split()[0] for x in VOTES.split(", ")]
            kinds = [pa.int64(), pa.string(), pa.string()] + [pa.int32()] * 4
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    cast = documents.select(F.col("doc_id").cast("bigint"), "text", "source", "pack").where("text IS NOT NULL")
    said = cut_lineage(cast.mapInArrow(vote, VOTES))
    # The source's vote: whether its documents have, by their sections and headings, the subject more, or less, often than all.
    docs = max(1, said.select("doc_id").distinct().count())
    signs = said.where("section = 1 OR heading = 1")
    usual = signs.groupBy("subject").agg((F.count(F.lit(1)) / F.lit(docs)).alias("usual"))
    of_source = said.where("source IS NOT NULL").groupBy("source").agg(F.countDistinct("doc_id").alias("docs"))
    rates = signs.where("source IS NOT NULL").groupBy("source", "subject").agg(F.count(F.lit(1)).alias("n")).join(of_source, "source").join(usual, "subject")
    lift = rates.select(F.concat_ws("\u0001", "source", "subject").alias("at"), (F.col("n") / F.col("docs") / F.col("usual")).alias("lift"))
    voted = salted_join(said.withColumn("at", F.when(F.col("source").isNotNull(), F.concat_ws("\u0001", "source", "subject"))), lift, "at", ["doc_id"], "left")
    voted = voted.withColumn("source_vote", F.when(F.col("source").isNull(), ABSTAIN).when(F.col("lift") >= 1.5, YES).when(F.coalesce("lift", F.lit(0.0)) <= 0.5, NO).otherwise(ABSTAIN))
    functions = ["lexicon", "section", "heading", "address", "source_vote"]
    counted = voted.groupBy(*functions).agg(F.count(F.lit(1)).alias("n")).toPandas()
    if not len(counted):
        return said.select("doc_id", "subject", "lexicon", F.lit(0.0).alias("posterior")).where(F.lit(False))
    counted = counted.sort_values(functions)
    patterns = counted[functions].to_numpy(dtype=int)
    posterior, _, _ = fit_accuracies(patterns, counted["n"].to_numpy(dtype=float))
    known = spark.createDataFrame([(*map(int, p), float(x)) for p, x in zip(patterns, posterior, strict=True)], ", ".join(f"{f} int" for f in functions) + ", posterior double")
    return voted.join(F.broadcast(known), functions).select("doc_id", "subject", "lexicon", "posterior")


def subjects(documents: DataFrame, examples: DataFrame, areas: DataFrame) -> DataFrame:
    """``(doc_id, subject)`` of posterior CUT or more."""
    return subject_posteriors(documents, examples, areas).where(F.col("posterior") >= CUT).select("doc_id", "subject")
