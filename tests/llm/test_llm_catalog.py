"""The subpackage's queries on the smallest tables, where these are there."""

from collections import Counter
from pathlib import Path

import pytest

from packloom.llm import catalog

DATA = Path("/root/testdata/sf0.001")
FOUND = {
    "p1_found": [("delivery_id", "bigint"), ("defect_type", "string")],
    "p3_found": [("id_a", "bigint"), ("id_b", "bigint")],
    "p5_found": [("pack", "string"), ("group_pack", "string")],
    "p7_found": [("doc_id", "bigint"), ("item_id", "bigint")],
    "p8_found": [("doc_id", "bigint"), ("subject", "string")],
}


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(FOUND))
def test_found_has_its_columns_and_rows(spark, name):
    df = catalog.queries()[name](spark, str(DATA))
    assert df.dtypes == FOUND[name]
    rows = df.collect()
    assert rows and max(Counter(rows).values()) == 1


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
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
    assert Counter(tuple(r) for r in df.select(*columns).collect()) == Counter(tuple(r[i] for i in at) for r in rel.fetchall())


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_every_pack_and_text_is_placed(spark):
    q = catalog.queries()
    packs = q["p5_packs"](spark, str(DATA)).toPandas()
    assert packs.pack.is_unique and packs.split_name.notna().all() and packs.groupby("group_pack").split_name.nunique().max() == 1
    samples = q["p5_samples"](spark, str(DATA))
    assert samples.where("split_name IS NULL").count() == 0 and samples.count() > 0
    fill = q["p6_fill"](spark, str(DATA)).toPandas()
    assert set(fill.container) == {"small", "medium", "large"} and fill.fill.max() <= 1
