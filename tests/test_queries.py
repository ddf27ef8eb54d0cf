"""Every registered query of the engine against its DuckDB oracle."""

import os
from difflib import SequenceMatcher

import duckdb
import pytest

from quillmesh.plans import catalogue
from quillmesh.sources import tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return con


WITHOUT = {"title_fuzzy_topk", "title_fuzzy_batch", "render_similarity_bibtex"}


def test_every_query_has_an_oracle():
    assert catalogue.QUERIES.keys() - catalogue.ORACLES.keys() == WITHOUT


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query(spark, oracle, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = oracle.sql(catalogue.ORACLES[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    rows = [tuple(r[c] for c in order) for r in got.collect()]
    at = [want.columns.index(c) for c in order]
    assert sorted(map(str, rows)) == sorted(str(tuple(r[k] for k in at)) for r in want.fetchall())


def by_definition(query, titles, least):
    """(similarity, rec_key, title) of the first of each title, by the score's definition."""
    out = []
    for key, title, year in titles:
        low, q = title.lower(), query.lower()
        score = (max(0.8, len(q) / len(low)) if low else 0.0) if q in low else SequenceMatcher(None, q, low).ratio()
        if score >= least:
            out.append((-score, -(year or -1), key, title))
    return [(-s, key, title) for s, _, key, title in sorted(out)]


@pytest.fixture(scope="module")
def titles(spark):
    rows = sorted(((-(r.year or -1), r.rec_key, r.title, r.year) for r in tables.publications(spark, SF).collect()))
    first = {}
    for _, key, title, year in rows:
        first.setdefault(title, (key, title, year))
    return list(first.values())


def test_fuzzy_queries_by_definition(spark, titles):
    query = catalogue.title_of(tables.publications(spark, SF), 7)
    want = by_definition(query, titles, 0.5)
    got = catalogue.QUERIES["title_fuzzy_topk"](spark, SF).orderBy("position").collect()
    assert [(round(s, 9), k, t) for s, k, t in want[:10]] == [(r.similarity, r.rec_key, r.title) for r in got]
    blocks = [r.block for r in catalogue.QUERIES["render_similarity_bibtex"](spark, SF).orderBy("position").collect()]
    assert len(blocks) == min(5, len(want))
    for n, (block, (score, key, title)) in enumerate(zip(blocks, want), 1):
        assert block.startswith(f"{n}. {title} [Similarity: {score:.2f}]\n") and f"   Record key: {key}\n" in block and "   BibTeX:\n      @article{" in block


def test_batch_by_definition(spark, oracle, titles):
    asked = oracle.sql("SELECT item_id, text FROM benchmark WHERE item_id % 50 = 0").fetchall()
    got = catalogue.QUERIES["title_fuzzy_batch"](spark, SF).collect()
    want = {(i, n, k, t, round(s, 9)) for i, text in asked for n, (s, k, t) in enumerate(by_definition(text, titles, 0.45)[:5], 1)}
    assert {(r.query_id, r.position, r.rec_key, r.title, r.similarity) for r in got} == want and len(asked) > 0


def test_query_table_by_definition(spark, titles):
    """Many queries of all lengths, in one block and in many; the plan does not grow with them."""
    from quillmesh.operators import fuzzy

    pubs = tables.publications(spark, SF)
    texts = [t for _, t, _ in titles[::9]] + [t[:12] for _, t, _ in titles[::11]] + [t.swapcase()[3:] + " x" for _, t, _ in titles[::13]] + ["", "zzz", None]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id int, title string")
    want = {(i, n, k, round(s, 9)) for i, q in enumerate(texts) if q is not None for n, (s, k, _) in enumerate(by_definition(q, titles, 0.55)[:4], 1)}
    whole = fuzzy.fuzzy_titles(pubs, asked, 0.55, 4)
    for found in (whole, fuzzy.fuzzy_titles(pubs, asked, 0.55, 4, block=2000)):
        assert {(r.query_id, r.position, r.rec_key, round(r.similarity, 9)) for r in found.collect()} == want
    few = fuzzy.fuzzy_titles(pubs, asked.limit(1), 0.55, 4)
    size = [len(x._jdf.queryExecution().optimizedPlan().toString()) for x in (whole, few)]
    assert abs(size[0] - size[1]) < 200 and len(want) > 30


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0
    assert set(catalogue.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
