import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packloom.llm.packing import best_fit, fill_shard, local_search, pack, token_counts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120))
def test_fill_never_exceeds_and_local_search_never_adds_bins(sizes):
    sizes = np.array(sizes, dtype=np.int64)
    where = fill_shard(sizes, 100)
    fills = np.bincount(where, weights=sizes) if len(sizes) else np.zeros(0)
    assert (fills <= 100).all()
    if len(sizes):
        before, fill = best_fit(sizes, 100)
        assert len(set(where.tolist())) <= len(set(before.tolist()))
        squares = lambda w: (np.bincount(w, weights=sizes) ** 2).sum()
        assert squares(local_search(sizes, before, fill, 100)) >= squares(before)


def test_exchange_empties_a_bin():
    # Three bins of 9, 9 and 6 of 12: only exchanges make two full ones.
    sizes = np.array([5, 4, 5, 4, 3, 3], dtype=np.int64)
    after = local_search(sizes, np.array([0, 0, 1, 1, 2, 2]), [9, 9, 6], 12)
    assert len(set(after.tolist())) == 2 and (np.bincount(after, weights=sizes) <= 12).all()


def test_tiny_items_and_pairs_within_a_bin():
    sizes = np.r_[np.ones(9000, dtype=np.int64), np.full(3, 4000)]
    where, fill = best_fit(sizes, 8192)
    assert len(set(local_search(sizes, where, fill, 8192).tolist())) == -(-int(sizes.sum()) // 8192)
    # Two of bin 1 (2 and 3, not neighbours by size beside 4 and 6) against the 8 of bin 0, and the other way round.
    for where in ([0, 1, 1, 1, 1, 2], [1, 0, 0, 0, 0, 2]):
        after = local_search(np.array([8, 2, 3, 4, 6, 12]), np.array(where), np.bincount(where, weights=[8, 2, 3, 4, 6, 12]).astype(int).tolist(), 18)
        assert np.bincount(after, weights=[8, 2, 3, 4, 6, 12]).max() <= 18 and len(set(after.tolist())) == 2


def test_more_sizes_than_the_bound_are_refused(spark, monkeypatch):
    monkeypatch.setattr("packloom.llm.packing.MOST_SIZES", 2)
    counts = spark.createDataFrame([(1, 5)], "doc_id bigint, tokens bigint")
    kinds = spark.createDataFrame([(str(i), 10 + i) for i in range(3)], "container string, capacity bigint")
    with pytest.raises(ValueError):
        pack(counts, kinds)


def test_pack_covers_every_token_once(spark):
    rows = [(i, (i * 37) % 900) for i in range(2000)] + [(9001, 512), (9002, 1025), (9003, 100_000)]
    counts = spark.createDataFrame(rows, "doc_id bigint, tokens bigint")
    kinds = spark.createDataFrame([("s", 512), ("m", 2048), ("zero", 0)], "container string, capacity bigint")
    placed = pack(counts, kinds).toPandas()
    assert set(placed.container) == {"s", "m"}
    for name, capacity in (("s", 512), ("m", 2048)):
        own = placed[placed.container == name]
        assert own.groupby("bin").tokens.sum().max() <= capacity
        assert own.groupby("doc_id").tokens.sum().to_dict() == {d: t for d, t in rows if t}
        parts = own.groupby("doc_id").size()
        assert all(parts[d] == -(-t // capacity) for d, t in rows if t)
        assert own.tokens.sum() / (own.bin.nunique() * capacity) > 0.98
    assert pack(counts.where(F.lit(False)), kinds).count() == 0


def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "水" * 20_000), (2, ""), (3, None), (4, "a b")], "doc_id bigint, text string")
    got = {r[0]: r[1] for r in token_counts(df, "doc_id", "text").collect()}
    assert set(got) == {1, 2, 4} and got[2] == 0 and got[1] > 10_000 and got[4] == 2
