"""Scalar functions against goldens and brute force."""

import random

import pytest
from pyspark.sql import functions as F

from lichenmill.functions import cigar, flags, misc, pairwise, quality, sequences


def one(spark, *cols, **values):
    names = {k: F.lit(v) if v is not None else F.lit(None).cast("string") for k, v in values.items()}
    return spark.range(1).select(*[c.alias(k) for k, c in names.items()]).select(*cols).first()


def test_flags(spark):
    df = spark.createDataFrame([(f,) for f in [0, 1, 4, 16, 99, 147, 256, 2048, 2304, 65535, None]], "flags int")
    for name, (mask, short) in flags.BITS.items():
        got = df.select(flags.PREDICATES[name]("flags"), flags.PREDICATES[short]("flags"), "flags").collect()
        assert all(a == b == (None if f is None else bool(f & mask)) for a, b, f in got)
    assert [r[0] for r in df.select(flags.alignment_is_primary("flags")).collect()] == [True] * 6 + [False] * 4 + [None]
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(flags.is_paired(F.lit(70000))).collect()


def test_identity_goldens(spark):
    df = spark.createDataFrame([("18M3D2M2D2M1I22M", 7, "14A3^CAG2^TG24")], "c string, n long, m string")
    kinds = ("gap_excluded", "blast", "gap_compressed")
    got = df.select(*[cigar.alignment_seq_identity("c", "n", "m", k) for k in kinds]).first()
    assert [round(x, 3) for x in got] == [0.977, 0.86, 0.915]


def test_identity_edges(spark):
    df = spark.createDataFrame([("*", 1, "5"), ("", 1, "5"), (None, 1, "5"), ("5Z", 1, "5"), ("0M", 1, "5"), ("5M", None, None), ("5M", 9, "")], "c string, n long, m string")
    for k in ("gap_excluded", "blast", "gap_compressed"):
        assert [r[0] for r in df.select(cigar.alignment_seq_identity("c", "n", "m", k)).collect()] in ([None] * 7, [None] * 5 + [None, None])
    with pytest.raises(Exception, match="Invalid type parameter for alignment_seq_identity"):
        spark.createDataFrame([("5M", 1, "5")], "c string, n long, m string").select(cigar.alignment_seq_identity("c", "n", "m", "x")).collect()


@pytest.mark.parametrize(
    "text, said",
    [("10Z", "Invalid CIGAR operation: Z"), ("10M5", "incomplete operation"), ("M", "operation without length"), ("0M", "zero length"), ("99999999999999999999M", "length exceeds maximum")],
)
def test_cigar_errors(spark, text, said):
    with pytest.raises(Exception, match=said):
        spark.range(1).select(cigar.alignment_query_length(F.lit(text))).collect()


def test_query_length_and_coverage(spark):
    df = spark.createDataFrame([("5S10M2I3D4H",), ("*",), ("",), (None,), ("4D",)], "c string")
    got = df.select(
        cigar.alignment_query_length("c"), cigar.alignment_query_length("c", False), cigar.alignment_query_coverage("c"), cigar.alignment_query_coverage("c", "mapped")
    ).collect()
    assert [tuple(r) for r in got] == [(21, 17, 10 / 21, 12 / 21), (0, 0, 0.0, 0.0), (0, 0, 0.0, 0.0), (None,) * 4, (0, 0, 0.0, 0.0)]
    with pytest.raises(Exception, match="Invalid coverage type"):
        spark.range(1).select(cigar.alignment_query_coverage(F.lit("5M"), "x")).collect()


def test_cigar_brute_force(spark):
    rnd = random.Random(1)
    texts = ["".join(f"{rnd.randint(1, 30)}{rnd.choice('MIDNSHP=X')}" for _ in range(rnd.randint(1, 9))) for _ in range(200)] + ["5I3I", "5D3I"]
    g = cigar.Cigar(F.col("c"))
    rows = spark.createDataFrame([(t,) for t in texts], "c string").select("c", g.total("M=X"), g.total("ID"), g.gap_opens(), g.problem()).collect()
    import re

    for t, aligned, gaps, opens, problem in rows:
        ops = [(int(n), o) for n, o in re.findall(r"(\d+)(.)", t)]
        assert aligned == sum(n for n, o in ops if o in "M=X") and gaps == sum(n for n, o in ops if o in "ID") and problem is None
        assert opens == sum(o in "ID" and (i == 0 or ops[i - 1][1] != o) for i, (_, o) in enumerate(ops))


def test_cigar_totals_of_odd_texts():
    import pyarrow as pa

    rnd = random.Random(3)
    texts = []
    for _ in range(4000):
        t = "".join(f"{rnd.choice([1, 2, 30, 999, 0 if rnd.random() < 0.02 else 7, 10 ** rnd.randint(0, 17)])}{rnd.choice('MIDNSHP=X')}" for _ in range(rnd.randint(0, 9)))
        if rnd.random() < 0.1:
            t = t[: rnd.randint(0, len(t))] + rnd.choice(["", "Z", "5", "é", "M", " ", "99999999999999999999M"]) + t[rnd.randint(0, len(t)) :]
        texts.append(rnd.choice([None, "*", ""]) if rnd.random() < 0.02 else t)
    whole = pa.array(texts)
    for part in (whole, whole.slice(13, 500), whole.slice(3, 0)):
        totals, problems = cigar.cigar_totals(part)
        for i, t in enumerate(part.to_pylist()):
            want, said = cigar._one(t or "")
            assert totals[i].tolist() == want and problems.get(i) == said, t


def test_md(spark):
    a, b = cigar.md_counts(F.col("m"))
    df = spark.createDataFrame([("14A3^CAG2^TG24",), ("5*4",), ("0A0C",)], "m string")
    assert [tuple(r) for r in df.select(a, b).collect()] == [(43, 1), (54, 0), (0, 2)]


def test_reverse_complement(spark):
    assert one(spark, sequences.sequence_dna_reverse_complement("s"), s="AcGTRYSWKMBDHVNn-.")[0] == ".-nNBDHVKMWSRYACgT"
    assert one(spark, sequences.sequence_rna_reverse_complement("s"), s="ACGUu")[0] == "aACGU"
    assert one(spark, sequences.sequence_dna_reverse_complement("s"), s="")[0] == ""
    assert one(spark, sequences.sequence_dna_reverse_complement("s"), s=None)[0] is None
    with pytest.raises(Exception, match="Invalid DNA base 'X' at position 4"):
        one(spark, sequences.sequence_dna_reverse_complement("s"), s="AZGX")
    with pytest.raises(Exception, match="Invalid RNA base 'T' at position 1"):
        one(spark, sequences.sequence_rna_reverse_complement("s"), s="TA")


def test_patterns(spark):
    assert one(spark, sequences.sequence_dna_as_regexp("s"), s="ARn-.")[0] == "A[AG][acgt].."
    assert one(spark, sequences.sequence_rna_as_regexp("s"), s="AYU")[0] == "A[CU]U"
    with pytest.raises(Exception, match="Invalid DNA base 'Z' at position 2"):
        one(spark, sequences.sequence_dna_as_regexp("s"), s="AZGX")


def _gotoh(q, s, x=4, o=6, e=2):
    inf = 10**9
    h = [[inf] * (len(s) + 1) for _ in range(len(q) + 1)]
    i_, d = [r[:] for r in h], [r[:] for r in h]
    for i in range(len(q) + 1):
        for j in range(len(s) + 1):
            if i:
                i_[i][j] = min(h[i - 1][j] + o + e, i_[i - 1][j] + e)
            if j:
                d[i][j] = min(h[i][j - 1] + o + e, d[i][j - 1] + e)
            m = 0 if i == j == 0 else h[i - 1][j - 1] + (q[i - 1] != s[j - 1]) * x if i and j else inf
            h[i][j] = min(m, i_[i][j], d[i][j])
    return h[-1][-1]


def test_pairwise_brute_force():
    rnd = random.Random(2)
    for _ in range(150):
        q, s = ("".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 14))) for _ in range(2))
        best = _gotoh(q, s)
        cost, ops = pairwise.align(q, s)
        assert cost == best == pairwise.align(q, s, trace=False)[0]
        a, b = pairwise.gapped(q, s, ops)
        assert a.replace("-", "") == q and b.replace("-", "") == s
        runs = [o for i, o in enumerate(ops) if o in "ID" and (i == 0 or ops[i - 1] != o)]
        assert cost == ops.count("X") * 4 + len(runs) * 6 + sum(ops.count(o) for o in "ID") * 2


def test_pairwise_groups(monkeypatch):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    q = [text(rnd.randint(0, 20)) for _ in range(120)] + ["é好", "", "A" * 300]
    s = [text(rnd.randint(0, 20)) for _ in range(120)] + ["é坏x", "", "A" * 290]
    for penalties in ((4, 6, 2), (1, 0, 1), (2**29, 1, 1)):
        want = [pairwise.align(a, b, *penalties) for a, b in zip(q, s)]
        monkeypatch.setattr(pairwise, "CELLS", 2000)  # many groups, some of one pair
        assert list(zip(*pairwise.align_all(q, s, *penalties))) == want
        monkeypatch.setattr(pairwise, "CELLS", 1 << 25)
        assert list(zip(*pairwise.align_all(q, s, *penalties))) == want
        assert pairwise.align_all(q, s, *penalties, trace=False)[0] == [c for c, _ in want] == [_gotoh(a, b, *penalties) for a, b in zip(q[:122], s[:122])] + [want[-1][0]]


def test_pairwise_columns(spark):
    df = spark.createDataFrame([("ACGT", "ACGT"), ("ACGT", "ACAT"), ("", ""), (None, "A"), ("ACGTT", "ACT")], "q string, s string")
    rows = df.select(pairwise.align_pairwise_score("q", "s").alias("n"), pairwise.align_pairwise_cigar("q", "s").alias("c"), pairwise.align_pairwise_full("q", "s").alias("f")).collect()
    assert [r.n for r in rows] == [0, 4, 0, None, 10]
    assert rows[1].c == (4, "2=1X1=") and rows[2].c == (0, "") and rows[3].c is None and rows[3].f is None
    assert rows[4].f.query_aligned == "ACGTT" and rows[4].f.subject_aligned.replace("-", "") == "ACT"
    for bad in ({"method": "x"}, {"mismatch": 0}, {"gap_open": -1}, {"gap_extend": 0}):
        with pytest.raises(ValueError):
            pairwise.align_pairwise_score("q", "s", **bad)


def test_gff_attributes(spark):
    assert one(spark, misc.parse_gff_attributes("s"), s="ID=a=b;flag;")[0] == {"ID": "a", "flag": None, "": None}


def test_quality(spark):
    df = spark.createDataFrame([([0, 40, 93],), ([],)], "q array<smallint>")
    assert [r[0] for r in df.select(quality.encode_quality(F.col("q"))).collect()] == ["!I~", ""]
    assert spark.range(1).select(quality.decode_quality(F.lit("!I~"))).first()[0] == [0, 40, 93]
    with pytest.raises(Exception, match="outside 0..93"):
        spark.range(1).select(quality.decode_quality(F.lit("!"), 64)).collect()
    w = spark.createDataFrame([([30, 5, 5, 30],), ([30, 30],), ([5],)], "q array<int>").select(quality.find_low_quality_window(F.col("q"), 10, 2)).collect()
    assert [r[0] for r in w] == [1, 3, 2]
