"""The registered queries against DuckDB, and the pipeline stage by stage."""

import os
import re
from collections import Counter

import pytest

from lichenmill.llm import _common, exact, oracles, queries, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    for name, sql in oracles.oracle_sql().items():
        df = queries.queries()[name](spark, SF)
        cur = con.execute(sql)
        names = [d[0] for d in cur.description]
        assert sorted(names) == sorted(df.columns), name
        want = [tuple(plain(r[names.index(c)]) for c in df.columns) for r in cur.fetchall()]
        assert sorted(map(repr, (tuple(map(plain, r)) for r in df.collect()))) == sorted(map(repr, want)), name


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    assert [k for k, _ in p.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in p.STAGES:
        docs = stage(spark, docs, SF).persist()
        after = docs.count()
        assert after > 0
        if name != "packing":
            assert docs.columns == columns
        if name in ("quality", "exact_dedup", "near_dedup"):
            assert after <= before
        if name == "exact_dedup":
            assert exact.exact_groups(docs).where("group_size > 1").count() == 0
        before = after
    assert docs.columns[:3] == ["doc_id", "start", "length"]


def _similar_by_brute_force(rows, similarity=0.8, k=5):
    """doc_id to the smallest doc_id that links of similar texts lead to; candidates share a shingle."""
    shingles = {}
    for i, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", text.encode().translate(_common.LOWER_BYTES))
        shingles[i] = {tuple(words[a : a + k]) for a in range(max(1, len(words) - k + 1))}
    holders: dict = {}
    for i, s in shingles.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    root = {i: i for i in shingles}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n_links = 0
    for i, s in shingles.items():
        both = Counter(j for x in s for j in holders[x] if j < i)
        for j, n in both.items():
            if n / (len(s) + len(shingles[j]) - n) >= similarity:
                n_links += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in root}, n_links


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_near_duplicates_of_the_documents(spark, sf):
    """Whole tables against all pairs that share a shingle."""
    path = f"/root/testdata/{sf}/documents.parquet"
    if not os.path.exists(path):
        pytest.skip("no test data")
    queries.configure(spark)
    docs = spark.read.parquet(path)
    docs = exact.drop_exact(docs) if sf == "sf0.1" else docs
    rows = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    want, n_links = _similar_by_brute_force(rows)
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert n_links > 10 and got == want
