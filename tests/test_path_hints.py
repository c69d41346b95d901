"""Path hints against a search of the same relations and against their SQL, on the smallest tables, where these are there."""

from collections import defaultdict
from pathlib import Path

import pytest

from packloom.operators import retrieval
from packloom.plans import catalog
from packloom.sources import relations as R

DATA = Path("/root/testdata/sf0.001")


def maximal(ids: set, links: set) -> set:
    out, paths = defaultdict(list), set()
    for a, b in links:
        out[a].append(b)
    fed = {b for _, b in links}
    stack = [(x,) for x in (ids - fed or ids)]
    while stack:
        p = stack.pop()
        if not out[p[-1]] or len(p) == 12:
            paths.add(p)
        else:
            stack += [(*p, b) for b in out[p[-1]] if b not in p]
    return paths


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
def test_path_hints_against_a_search_and_the_sql(spark):
    import duckdb

    d = str(DATA)
    ids, links, relevance = defaultdict(set), defaultdict(set), {}
    for r in R.candidates(spark, d).select("pack", "event_id").collect():
        ids[r["pack"]].add(r["event_id"])
    for r in R.edges(spark, d).select("pack", "src", "dst").collect():
        links[r["pack"]].add((r["src"], r["dst"]))
    with_edges = {r["pack"] for r in R.raw_edges(spark, d).select("pack").collect()}
    for r in retrieval.ranked_candidates(spark, d).collect():
        relevance[r["sample_key"], r["event_id"]] = r["relevance"]
    paths = {p: maximal(ids[p], links[p]) for p in with_edges}
    want = set()
    for r in retrieval.known_anchors(spark, d).collect():
        named = set(r["ids"])
        key = lambda p: (-round(len(named & set(p)) / max(1, len(named)), 6), -round(sum(relevance.get((r["sample_key"], x), 0.0) for x in p) / len(p), 6), -len(p), ">".join(p))  # noqa: B023, E731
        want |= {(r["sample_key"], ">".join(p), i) for i, p in enumerate(sorted(paths.get(r["pack"], ()), key=key)[:3], 1)}
    got = {tuple(r) for r in catalog.queries()["graph_path_hints"](spark, d).collect()}
    assert got == want and got
    con = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        con.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    assert set(con.sql(catalog.oracle_sql()["graph_path_hints"]).fetchall()) == want
