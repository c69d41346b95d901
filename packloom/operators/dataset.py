"""Training sets: splits, flags, alternatives, mixes and samples. All draws come from digests, so they repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.functions import text as T


def fraction(*parts: Column | str) -> Column:
    """A number in [0, 1) from the digest of the parts, joined by colons (52 bits of it)."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def whole_digest(*parts: Column | str) -> Column:
    """The first 64 bits of the digest of the parts, joined by colons, as a decimal without sign."""
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def digest_order_split(groups: DataFrame, seed: int, fit: float = 0.8, validation: float = 0.1) -> DataFrame:
    """``(domain, grp, size, split_name)``: groups of each domain, in the order of their digests, fill fit, validation and holdout by size.

    A group goes to fit while the sizes before it are below the rounded target (halves to even), then to validation likewise. Sizes before a
    group are summed in two levels (256 buckets of the digest, then inside a bucket), so a domain never meets in one task.
    """
    h = groups.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), "grp"))).withColumn("__b", F.substring("__h", 1, 2))
    buckets = h.groupBy("domain", "__b").agg(F.sum("size").alias("__s"))
    w = Window.partitionBy("domain")
    offsets = buckets.select("domain", "__b", (F.sum("__s").over(w.orderBy("__b")) - F.col("__s")).alias("__at"), F.sum("__s").over(w).alias("__total"))
    inside = F.sum("size").over(Window.partitionBy("domain", "__b").orderBy("__h", "grp").rowsBetween(Window.unboundedPreceding, -1))
    placed = h.withColumn("__in", F.coalesce(inside, F.lit(0))).join(offsets, ["domain", "__b"]).withColumn("__before", F.col("__at") + F.col("__in"))
    in_fit = F.col("__before") < F.bround(F.col("__total") * fit)
    totals = placed.where(in_fit).groupBy("domain").agg(F.sum("size").alias("__fit"))
    placed = placed.join(totals, "domain", "left")
    in_validation = F.col("__before") - F.coalesce("__fit", F.lit(0)) < F.bround(F.col("__total") * validation)
    name = F.when(in_fit, "fit").when(in_validation, "validation").otherwise("holdout")
    return placed.select("domain", "grp", "size", name.alias("split_name"))


def quality_flags(chains: Column, events: Column, docs: Column, pairs: Column, kind: Column, required: Column, level: Column) -> Column:
    """Flags of a gold item against its pack's events, documents and edges (``a>b``)."""
    full = F.filter(chains, lambda c: F.size(c) > 0)
    outside = lambda known: F.exists(full, lambda c: F.size(F.array_except(c, known)) > 0)
    rules = [
        ("missing_event_id", outside(events)),
        ("not_document_id_compatible", outside(docs)),
        ("step_absent_from_given_edges", F.exists(full, lambda c: F.size(F.array_except(T.steps(c), pairs)) > 0)),
        ("unanswerable_with_evidence", (kind == "unanswerable") & (F.size(full) > 0)),
        ("no_required_facts", F.size(required) == 0),
        ("multiple_gold_paths", F.size(F.array_distinct(chains)) > 1),
        ("nonstandard_confidence_level", level.isNotNull() & ~level.isin("certain", "probable", "possible")),
    ]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())


def compatible_chains(chains: Column, answers: Column, allowed: Column) -> Column:
    """Whole alternatives that the allowed ids can express, without repeats; for a refusal without chains the one empty chain."""
    fits = F.array_distinct(F.filter(chains, lambda c: (F.size(F.array_distinct(c)) == F.size(c)) & (F.size(F.array_except(c, allowed)) == 0)))
    refused = (F.size(chains) == 0) & (F.size(answers) == 1) & (F.get(answers, F.lit(0)) == "无法确定")
    return F.when(refused, F.array(F.array().cast("array<string>"))).otherwise(fits)


def chosen_chain(alternatives: Column, pairs: Column, annotated: Column, answers: Column, anchors: Column, question: Column) -> Column:
    """The alternative to train on: supported by the graph, as annotated, in the answer's order, with most anchors, then shorter (longer if the whole is asked), then larger ids."""
    full = F.filter(alternatives, lambda c: F.size(c) > 0)
    answer = F.array_join(answers, "\n")
    longer = question.rlike("完整|多个阶段")

    def rank(c: Column) -> Column:
        places = F.transform(c, lambda x: F.position(x, answer))
        ordered = F.forall(places, lambda p: p > 0) & (places == F.array_sort(places))
        return F.struct(
            (F.size(F.array_except(T.steps(c), pairs)) == 0).alias("a"),
            F.coalesce(c == annotated, F.lit(False)).alias("b"),
            ordered.alias("c"),
            F.size(F.array_intersect(anchors, c)).alias("d"),
            F.when(longer, F.size(c)).otherwise(-F.size(c)).alias("e"),
            c.alias("chain"),
        )

    best = F.array_max(F.transform(full, rank))["chain"]
    return F.when(F.size(alternatives) == 0, None).otherwise(F.coalesce(best, F.array().cast("array<string>")))


def weighted_view(views: Column, weights: dict[str, float], draw: Column) -> Column:
    """One of the available views by cumulative weight; null where none has a weight."""
    usable = F.filter(F.array(*[F.lit(v) for v in sorted(weights) if weights[v] > 0]), lambda v: F.array_contains(views, v))
    table = F.create_map(*[x for v in sorted(weights) for x in (F.lit(v), F.lit(float(weights[v])))])
    total = F.aggregate(usable, F.lit(0.0), lambda a, v: a + table[v])
    start = F.struct((draw * total).alias("left"), F.lit(None).cast("string").alias("view"))
    step = lambda acc, v: F.when(acc["view"].isNotNull(), acc).otherwise(F.struct((acc["left"] - table[v]).alias("left"), F.when(acc["left"] - table[v] < 0, v).alias("view")))
    picked = F.aggregate(usable, start, step, lambda acc: acc["view"])
    return F.when(total > 0, F.coalesce(picked, F.element_at(usable, -1)))


def quota_sample(rows: DataFrame, stratum: str, owner: str, key: str, quota: int, seed: int) -> DataFrame:
    """Up to ``quota`` rows of each stratum, in digest order, an owner's first row before any owner's second.

    The owner's turn comes first in the order, so further rows of an owner only fill what distinct owners leave open.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), stratum, key))
    turn = F.row_number().over(Window.partitionBy(stratum, owner).orderBy("__h", key))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy("__turn", "__h", key))
    return rows.withColumn("__h", h).withColumn("__turn", turn).withColumn("__p", place).where(F.col("__p") <= quota).drop("__h", "__turn", "__p")


def label_mask(prompt: Column, whole: Column) -> Column:
    """Labels for training on the reply alone: -100 for each of the prompt's tokens, then the reply's tokens."""
    n = F.least(F.size(prompt), F.size(whole))
    return F.concat(F.array_repeat(F.lit(-100), n), F.slice(whole, n + 1, F.greatest(F.size(whole) - n, F.lit(0))))
