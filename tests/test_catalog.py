"""Queries against their SQL on the smallest tables, where these are there."""

import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest

from packloom.plans import catalog

DATA = Path("/root/testdata/sf0.001")
NAMES = [
    "bm25_topk",
    "cosine_topk",
    "sentence_split",
    "simple_paths",
    "path_score_topk",
    "components_by_hash",
    "selected_chain",
    "summary_grouping_sets",
    "bootstrap_ci",
    "grouped_brier",
    "prediction_contract",
    "hash_split_80_10_10",
    "choose_chain",
    "view_mix_epoch",
    "coverage_full_outer",
    "idle_gate",
    "p2_found",
    "p2_kept",
    "p4_attempt_structs",
]


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return tuple(map(plain, v)) if isinstance(v, list) else v


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = catalog.queries()[name](spark, str(DATA))
    rel = con.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    want = Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    got = Counter(tuple(map(plain, r)) for r in df.select(*columns).collect())
    assert got == want


def test_every_sql_has_its_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_core_stands_without_the_subpackage():
    code = "import sys; sys.modules['packloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'bm25_topk' in q and 'p2_found' in q and 'p7_found' not in q; assert not any(m.startswith('packloom.llm.') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parents[1])
