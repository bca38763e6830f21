"""The driver contract and every registered query of the library proper against DuckDB."""

import os

import pytest

from lichenmill.plans import registry
from lichenmill.register import register

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_queries_against_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    for name, run in registry.queries().items():
        df = run(spark, SF)
        got = [tuple(map(plain, r)) for r in df.collect()]
        if name in registry.oracle_sql():
            cur = con.execute(registry.oracle_sql()[name])
            names = [d[0] for d in cur.description]
            assert sorted(names) == sorted(df.columns), name
            order = [names.index(c) for c in df.columns]
            want = [tuple(plain(r[i]) for i in order) for r in cur.fetchall()]
            assert sorted(map(repr, got)) == sorted(map(repr, want)), name


def test_sql_names(spark, tmp_path):
    from lichenmill.operators import align

    register(spark)
    row = spark.sql("SELECT is_paired(1), alignment_is_primary(256), sequence_dna_reverse_complement('ACGN'), parse_gff_attributes('a=b')['a'], engine_version()").first()
    assert tuple(row)[:4] == (True, False, "NCGT", "b")
    row = spark.sql(
        """SELECT alignment_seq_identity('18M3D2M2D2M1I22M', 7L, '14A3^CAG2^TG24') AS a, alignment_seq_identity('18M3D2M2D2M1I22M', 7L, '14A3^CAG2^TG24', 'blast') AS b,
           alignment_query_length('5S10M4H') AS c, alignment_query_length('5S10M4H', false) AS d, alignment_query_coverage('5S10M') AS e, alignment_query_coverage('5M5I', 'mapped') AS f,
           align_pairwise_score('ACGT', 'ACAT') AS g, align_pairwise_cigar('ACGT', 'ACAT', 'wfa2', 1, 0, 1).cigar AS h, align_pairwise_full('ACGTT', 'ACT').query_aligned AS i,
           sequence_dna_as_regexp('ARn-') AS j, sequence_rna_as_regexp('AYU') AS k, sequence_rna_reverse_complement('ACU') AS l"""
    ).first()
    assert [round(x, 3) for x in (row.a, row.b, row.e, row.f)] == [0.915, 0.86, 0.667, 1.0]
    assert tuple(row)[2:4] == (19, 15) and tuple(row)[6:] == (4, "2=1X1=", "ACGTT", "A[AG][acgt].", "A[CU]U", "AGU")
    with pytest.raises(Exception, match="Invalid DNA base"):
        spark.sql("SELECT sequence_dna_as_regexp('AZ')").collect()
    spark.createDataFrame([(1, 5, 9), (1, 9, 12), (1, 30, 20), (2, None, 1)], "k int, a long, b long").createOrReplaceTempView("spans")
    got = {r.k: r.x for r in spark.sql("SELECT k, compress_intervals(a, b) AS x FROM spans GROUP BY k").collect()}
    assert [tuple(i) for i in got[1]] == [(5, 12), (20, 30)] and got[2] is None
    fa = tmp_path / "x.fa"
    base = "ACGTTGCAAGCTTACGGATCCATGCAATTGCGCTAAGCTTCGATCGATTACGGCATGCATCGGATTACGCTAGCTAACGGTTA"
    fa.write_text(f">a one\n{base}\n>b\nGGGG\n")
    want = [("a", base), ("b", "GGGG")]
    assert [tuple(r) for r in spark.sql(f"SELECT read_id, sequence1 FROM read_fastx('{fa}')").collect()] == want
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW reads USING fastx OPTIONS (path '{fa}')")
    assert [tuple(r) for r in spark.sql("SELECT read_id, sequence1 FROM reads").collect()] == want
    sets = {r.read_id: r for r in spark.sql("SELECT * FROM extract_minimizer_set(TABLE(reads), 16, 4)").collect()}
    assert len(sets["a"].fwd_set) > 5 and sets["b"].fwd_set == []
    align.save_minimap2_index(spark, spark.table("reads").select("read_id", "sequence1"), str(tmp_path / "i.mmi"), k=15, w=5)
    got = spark.sql(f"SELECT read_id, reference, cigar FROM align_minimap2(TABLE(SELECT read_id, sequence1 FROM reads WHERE read_id = 'a'), '{tmp_path}/i.mmi')").collect()
    assert [tuple(r) for r in got] == [("a", "a", f"{len(base)}=")]
