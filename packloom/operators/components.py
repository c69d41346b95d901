"""Connected components of a bipartite graph of records and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packloom.operators.skew import hot_keys, salted_join
from packloom.session import cut_lineage


def propagate(links: DataFrame, most_rounds: int = 64) -> DataFrame:
    """``(record, label)``: the smallest record (by code points) that ``links`` ties, directly or not, to each record.

    Each round takes the minimum label over an entity's records and then over a record's entities, hands it to the
    label's own record too, and follows labels of labels, so the number of rounds grows with the logarithm of a
    chain's length. Minima are combined before each shuffle; hot records and entities are salted.
    """
    links = cut_lineage(links)
    hot_record, hot_entity = hot_keys(links, "record"), hot_keys(links, "entity")
    labels = links.groupBy("record").agg(F.min("record").alias("label"))
    for _ in range(most_rounds):
        tied = salted_join(links, labels, "record", ["entity"], "inner", hot_record)
        least = tied.groupBy("entity").agg(F.min("label").alias("least"))
        offer = salted_join(links, least, "entity", ["record"], "inner", hot_entity).groupBy("record").agg(F.min("least").alias("least"))
        seen = labels.join(offer, "record")
        # The record, and the record its label names, both take the smaller label.
        taken = seen.select("record", F.least("label", "least").alias("label")).unionByName(seen.where("least < label").select(F.col("label").alias("record"), F.col("least").alias("label")))
        hooked = taken.groupBy("record").agg(F.min("label").alias("label"))
        of = hooked.select(F.col("record").alias("label"), F.col("label").alias("next"))
        few = hot_keys(hooked, "label")
        jumped = salted_join(hooked, of, "label", ["record"], "left", few).select("record", F.least("label", F.coalesce("next", "label")).alias("label"))
        jumped = cut_lineage(jumped)
        changed = jumped.join(labels.withColumnRenamed("label", "old"), "record").where("label <> old").limit(1).count()
        labels = jumped
        if not changed:
            return labels
    raise RuntimeError(f"labels still change after {most_rounds} rounds")
