"""Intervals, counts, coverage, minimizers, trees and alignment."""

import random
from collections import Counter

import numpy as np
import pytest

from lichenmill.functions.misc import bowtie2_available
from lichenmill.operators import align, analysis, intervals, minimizers, tree


def _merge(rows):
    out = []
    for a, b in sorted((min(r), max(r)) for r in rows if None not in r):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def test_intervals(spark):
    rnd = random.Random(3)
    rows = [(k, rnd.randint(0, 60), rnd.randint(0, 60)) for k in range(5) for _ in range(rnd.randint(1, 15))]
    rows += [(0, None, 5), (7, None, None), (8, 10, 20), (8, 20, 30), (9, -(2**63), 2**63 - 1)]
    df = spark.createDataFrame(rows, "k int, start long, stop long")
    want = {k: _merge([r[1:] for r in rows if r[0] == k]) for k in {r[0] for r in rows}}
    got = sorted(tuple(r) for r in intervals.compress_intervals(df, "k").collect())
    assert got == sorted((k, *x) for k, v in want.items() for x in v)
    assert sorted(tuple(r) for r in intervals.compress_intervals(df, "k", stretch=7).collect()) == got
    lists = {r.k: r.intervals and [tuple(x) for x in r.intervals] for r in intervals.compress_intervals_list(df, "k").collect()}
    assert lists == {k: v or None for k, v in want.items()}
    from pyspark.sql import functions as F

    arrays = df.groupBy("k").agg(intervals.merge_interval_array(F.collect_list(F.struct("start", "stop"))).alias("x")).collect()
    assert {r.k: r.x and [tuple(x) for x in r.x] for r in arrays} == {k: v or None for k, v in want.items()}


def test_coverage(spark):
    a = spark.createDataFrame([("c1", 10, 21), ("c1", 30, 41), ("c1", 12, 15), ("none", 1, 5)], "reference string, position long, stop_position long")
    t = spark.createDataFrame([("g", 100), ("z", 0)], "genome_id string, total_length long")
    m = spark.createDataFrame([("c1", "g"), ("c2", "z")], "contig_id string, genome_id string")
    assert [tuple(r) for r in analysis.genome_coverage(a, t, m).collect()] == [("g", 22, 0.22)]


def test_counts_brute_force(spark):
    rnd = random.Random(4)
    rows = [(rnd.choice("st"), f"r{rnd.randint(0, 9)}", f"f{rnd.randint(0, 4)}", rnd.choice([0, 64, 128])) for _ in range(120)]
    df = spark.createDataFrame(rows, "sample_id string, read_id string, reference string, flags int")

    def brute(with_sample):
        one = {((s,) if with_sample else ()) + (r, f, bool(x & 64)) for s, r, f, x in rows}
        out = {}
        for x in one:
            n = sum(y[-3] == x[-3] and y[-1] == x[-1] for y in one)
            key = x[:-3] + (x[-2],)
            out[key] = out.get(key, 0) + 1 / n
        return {k: round(v, 9) for k, v in out.items()}

    assert {(r.feature_id,): round(r.value, 9) for r in analysis.woltka_ogu(df).collect()} == brute(False)
    got = {(r.sample_id, r.feature_id): round(r.value, 9) for r in analysis.woltka_ogu_per_sample(df).collect()}
    assert got == brute(True)


def _brute_minimizers(s, k, w, salt):
    h = [int("".join("1" if c in "AG" else "0" for c in s[i : i + k]), 2) ^ salt for i in range(len(s) - k + 1)]
    return sorted({min(h[i : i + min(w, len(h))]) for i in range(max(1, len(h) - w + 1))}) if h else []


def test_minimizers(spark):
    rnd = random.Random(5)
    seqs = ["".join(rnd.choice("ACGT") for _ in range(n)) for n in (5, 16, 20, 64, 120, 200)]
    df = spark.createDataFrame([(f"r{i}", s) for i, s in enumerate(seqs)], "read_id string, sequence1 string")
    for k, w, salt in ((16, 8, minimizers.SALT), (32, 5, 0), (64, 3, 2**64 - 1)):
        got = {r.read_id: r for r in minimizers.extract_minimizer_set(spark, df, k, w, salt).collect()}
        for i, s in enumerate(seqs):
            assert [int(x) for x in got[f"r{i}"].fwd_set] == _brute_minimizers(s, k, w, salt)
            assert [int(x) for x in got[f"r{i}"].rc_set] == _brute_minimizers(s.translate(str.maketrans("ACGT", "TGCA"))[::-1], k, w, salt)
    row = minimizers.extract_strand_minimizers(spark, df, 16, 8).where("read_id = 'r4'").first()
    assert len(row.fwd_hashes) == len(row.fwd_positions) and sorted({int(x) for x in row.fwd_hashes}) == _brute_minimizers(seqs[4], 16, 8, minimizers.SALT)
    for bad, said in (((15, 5), "k must be 16, 32, or 64"), ((16, 0), "w must be > 0")):
        with pytest.raises(ValueError, match=said):
            minimizers.extract_minimizer_set(spark, df, *bad)


def test_classify(spark, tmp_path):
    rnd = random.Random(6)
    refs = [(f"b{i}", "".join(rnd.choice("ACGT") for _ in range(300))) for i in range(3)]
    r = spark.createDataFrame(refs, "read_id string, sequence1 string")
    path = str(tmp_path / "i")
    minimizers.build_index(spark, r, path, 16, 8)
    q = spark.createDataFrame([("q0", refs[0][1][50:150]), ("q2", minimizers.reverse_complement(refs[2][1].encode()).decode()), ("no", "")], "read_id string, sequence1 string")
    got = {(x.read_id, x.bucket_name): x.score for x in minimizers.classify(spark, path, q, threshold=0.9).collect()}
    assert set(got) == {("q0", "b0"), ("q2", "b2")} and got["q0", "b0"] == 1.0
    assert minimizers.classify(spark, path, q, threshold=0.5, negative_index=path).count() == 0
    for f, said in ((lambda: minimizers.classify(spark, "none", q), "Failed to load"), (lambda: minimizers.classify(spark, path, q, threshold=2), "threshold must be between"), (lambda: minimizers.classify(spark, path, "absent"), "does not exist"), (lambda: minimizers.classify(spark, path, q.select("read_id")), "missing required column")):
        with pytest.raises(ValueError, match=said):
            f()


def test_newick():
    root = tree.parse_newick("((A:0.1{0},B:0.2{1}):0.3{2},'C''s x':0.4{3})[note [in]]r:0.0{4};ignored")
    assert tree.to_newick(root, True) == "((A:0.1{0},B:0.2{1}):0.3{2},'C''s x':0.4{3})r:0{4};"
    rows = tree.node_rows(root)
    assert [r[1] for r in rows] == ["A", "B", "", "C's x", "r"] and rows[-1][4] is None and rows[0][4] == 2
    assert tree.node_rows(tree.parse_newick(";")) == [(0, "", None, None, None, True)]
    deep = tree.parse_newick("(" * 5000 + "x" + ")" * 5000 + ";")
    assert len(tree.postorder(deep)) == 5001 and tree.to_newick(deep).count("(") == 5000
    for bad in ("", "(A,B)", "((A;", "(A:x);", "A)B;", "('A;"):
        with pytest.raises(ValueError):
            tree.parse_newick(bad)


def test_tree_metrics():
    root = tree.parse_newick("((A:1,B:2)x:3,C:4)r;")
    by = {n.name: n for n in tree.preorder(root)}
    assert tree.tip_names(root) == ["A", "B", "C"] and tree.distance_to_root(by["B"]) == 5
    assert tree.find_lca(by["A"], by["B"]) is by["x"] and tree.pairwise_distance(by["A"], by["C"]) == 8


def test_placements():
    root = tree.parse_newick("((A:1{0},B:2{1}):3{2},C:4{3});")
    p = [tree.Placement("f1", 0, 0.9, 0.25, 0.5), tree.Placement("f2", 0, 0.9, 0.75, 0.1), tree.Placement("f1", 1, 0.4, 0, 0)]
    assert tree.to_newick(tree.insert_placements(root, p)) == "((((A:0.25,f1:0.5):0.5,f2:0.1):0.25,B:2):3,C:4);"
    tie = [tree.Placement("f", 0, 0.5, 0, 0.2), tree.Placement("f", 1, 0.5, 0, 0.1)]
    assert tree.best_placements(tie)[0].edge == 1
    for bad, said in ((tree.Placement("f", 9, 1, 0, 0), "Unknown edge_id"), (tree.Placement("f", 0, 1, 2, 0), "exceeds"), (tree.Placement("f", 0, 1, -1, 0), "distal_length"), (tree.Placement("f", 0, 1, 0, -1), "pendant_length")):
        with pytest.raises(ValueError, match=said):
            tree.insert_placements(root, [bad])


def test_placements_on_an_edge_without_length():
    root = tree.parse_newick("((A{0},B:2{1}):3{2},C:4{3});")
    p = [tree.Placement("f1", 0, 0.9, 5.0, 0.5), tree.Placement("f2", 0, 0.9, 1.5, 0.1)]
    got = {n.name: n for n in tree.preorder(tree.insert_placements(root, p))}
    assert got["A"].length == 1.5 and got["f2"].parent.length == 3.5 and got["f1"].parent.length != got["f1"].parent.length
    with pytest.raises(ValueError, match="exceeds edge length"):  # no slack
        tree.insert_placements(tree.parse_newick("(A:1{0},B:2{1});"), [tree.Placement("f", 0, 1, 1 + 1e-12, 0)])
    with pytest.raises(ValueError, match="Too many placements"):
        tree.check_node_limit(4294967290, 3)


def test_best_placements_of_a_relation(spark):
    rnd = random.Random(8)
    rows = [(f"f{rnd.randint(0, 30)}", rnd.randint(0, 9), rnd.choice([0.5, 0.5 + 5e-10, 0.7]), 0.1, rnd.choice([0.1, 0.2, 0.3])) for _ in range(300)] + [(None, 1, 1.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "fragment_id string, edge_id long, like_weight_ratio double, distal_length double, pendant_length double")
    got = {r.fragment_id: (r.pendant_length, r.edge_id) for r in tree.best_placements_frame(df).collect()}
    want = {}
    for f in {r[0] for r in rows if r[0]}:
        mine = [r for r in rows if r[0] == f]
        most = max(r[2] for r in mine)
        want[f] = min((r[4], r[1]) for r in mine if r[2] >= most - 1e-9)
    assert got == want


def test_tree_relations(spark):
    rnd = random.Random(9)
    parent = {0: None} | {i: max(0, i - rnd.choice([1, 1, 1, 2, 30])) for i in range(1, 300)}  # deep
    length = {i: rnd.choice([None, 0.5, 1.0, 2.0]) for i in parent}
    df = spark.createDataFrame([(i, length[i], p) for i, p in parent.items()], "node_index long, branch_length double, parent_index long")

    def path(i):
        return [i] if parent[i] is None else [i, *path(parent[i])]

    root = lambda i: sum(length[x] or 0 for x in path(i)[:-1])
    got = {r.node_index: (r.depth, r.distance_to_root) for r in tree.depths(df).collect()}
    assert got == {i: (len(path(i)) - 1, root(i)) for i in parent}
    assert {r.node_index for r in tree.tip_rows(df).collect()} == set(parent) - set(parent.values())
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(60)] + [(7, 7), (0, 250)]
    rows = tree.common_ancestors(df, spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted((r.a, r.b) for r in rows) == sorted(pairs)
    for r in rows:
        common = next(x for x in path(r.a) if x in set(path(r.b)))
        assert r.ancestor == common and abs(r.distance - (root(r.a) + root(r.b) - 2 * root(common))) < 1e-9
    with pytest.raises(ValueError, match="cycle"):
        tree.depths(spark.createDataFrame([(0, 1.0, 1), (1, 1.0, 0)], "node_index long, branch_length double, parent_index long"))


def test_build_tree_errors():
    for rows, said in (
        ([], "empty"),
        ([{"node_index": 0, "parent_index": 1}, {"node_index": 1, "parent_index": 0}], "root"),
        ([{"node_index": 0, "parent_index": None}, {"node_index": 1, "parent_index": 7}], "does not exist"),
        ([{"node_index": 0, "parent_index": None}, {"node_index": 0, "parent_index": None}], "Duplicate"),
        ([{"node_index": 0, "parent_index": None, "branch_length": -1.0}], "Negative branch_length"),
        ([{"node_index": 0, "parent_index": None}, {"node_index": 1, "parent_index": 2}, {"node_index": 2, "parent_index": 1}], "cycle"),
    ):
        with pytest.raises(ValueError, match=said):
            tree.build_tree(rows)


def _refs(rnd):
    return [(f"ref{i}", "".join(rnd.choice("ACGT") for _ in range(600))) for i in range(3)]


def test_align(spark, tmp_path):
    rnd = random.Random(7)
    refs = _refs(rnd)
    s = spark.createDataFrame(refs, "read_id string, sequence1 string")
    mutated = refs[1][1][200:300]
    mutated = mutated[:50] + ("A" if mutated[50] != "A" else "C") + mutated[51:]
    q = spark.createDataFrame([("exact", refs[0][1][100:220]), ("back", align.reverse_complement(refs[2][1][10:130])), ("mut", mutated), ("none", "ACGT" * 30), (None, "ACGT")], "read_id string, sequence1 string")
    got = {r.read_id: r for r in align.align_minimap2(spark, q, s, max_secondary=0).collect()}
    assert set(got) == {"exact", "back", "mut"}
    e = got["exact"]
    assert (e.reference, e.position, e.stop_position, e.cigar, e.flags, e.tag_nm, e.tag_yt, e.mapq) == ("ref0", 101, 220, "120=", 0, 0, "UU", 60)
    assert got["back"].flags == 16 and (got["back"].position, got["back"].cigar) == (11, "120=")
    assert got["mut"].tag_nm == 1 and got["mut"].cigar == "50=1X49=" and got["mut"].tag_xm == 1
    path = str(tmp_path / "a.mmi")
    assert tuple(align.save_minimap2_index(spark, s, path).first()) == (True, path, 3)
    assert align.align_minimap2(spark, q, index_path=path, max_secondary=0).count() == 3
    shards = spark.createDataFrame([("exact", "a"), ("none", "a")], "read_id string, shard_name string")
    assert [r.read_id for r in align.align_minimap2_sharded(spark, q, str(tmp_path), shards, max_secondary=0).collect()] == ["exact"]
    pairs = spark.createDataFrame([("p", refs[0][1][100:200], align.reverse_complement(refs[0][1][250:350]))], "read_id string, sequence1 string, sequence2 string")
    a, b = align.align_minimap2(spark, pairs, s, max_secondary=0).orderBy("position").collect()
    assert (a.flags, b.flags, a.template_length, b.template_length, a.tag_yt) == (99, 147, 250, -250, "CP") and a.mate_reference == "="


def test_align_errors(spark, tmp_path):
    s = spark.createDataFrame([("a", "ACGT", None)], "read_id string, sequence1 string, sequence2 string")
    q = s.select("read_id", "sequence1")
    for f, said in (
        (lambda: align.align_minimap2(spark, q), "Exactly one"),
        (lambda: align.align_minimap2(spark, q, s), "sequence2"),
        (lambda: align.align_minimap2(spark, q, q.limit(0)), "empty"),
        (lambda: align.align_minimap2(spark, q, q, preset="x"), "preset"),
        (lambda: align.align_minimap2(spark, q, q, k=99), "k must be"),
        (lambda: align.align_minimap2_sharded(spark, q, "x", spark.createDataFrame([("a", None)], "read_id string, shard_name string")), "NULL shard_name"),
        (lambda: align.align_minimap2_sharded(spark, q, "x", spark.createDataFrame([], "read_id string, shard_name string")), "empty"),
    ):
        with pytest.raises(ValueError, match=said):
            f()
    if not bowtie2_available():
        with pytest.raises(RuntimeError, match="bowtie2"):
            align.align_bowtie2(spark, q, q)
    assert align.bowtie2_arguments("i", True, True, "fast", True, 1, 2, "--a b", True) == ["bowtie2", "-x", "i", "-f", "--interleaved", "-", "-p", "1", "--fast-local", "-k", "3", "--quiet", "--a", "b"]


def test_index_holds_its_minimizers(spark, tmp_path):
    rnd = random.Random(10)
    refs = [(f"r{i}", "".join(rnd.choice("ACGT") for _ in range(rnd.randint(0, 400)))) for i in range(9)]
    path = str(tmp_path / "x.mmi")
    align.save_minimap2_index(spark, spark.createDataFrame(refs, "read_id string, sequence1 string").repartition(3), path, k=15, w=5)
    want = align.Index(sorted(refs), 15, 5)
    for index in (align.load_index(spark, path), align.task_index(path)):
        assert index.subjects == want.subjects and (index.k, index.w) == (15, 5)
        assert all((getattr(index, c) == getattr(want, c)).all() for c in ("hashes", "subject", "place"))
    kinds = {f.name for f in spark.read.parquet(f"{path}/minimizers").schema}
    assert kinds == {"hash", "subject", "place"}
    with pytest.raises(ValueError, match="align in shards"):
        align._check_size(align.MOST_SUBJECT_BASES + 1, "x")


def test_classify_counts_in_blocks(spark, tmp_path, monkeypatch):
    rnd = random.Random(14)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    shared = text(120)
    refs = [(f"b{i}", text(rnd.randint(20, 90)) + (shared if i % 3 else "") + text(900 if i == 4 else 30)) for i in range(20)]
    reads = [(f"q{i}", s[i : i + 100]) for i, (_, s) in enumerate(refs)] + [("none", "ACG"), ("null", None)]
    path = str(tmp_path / "i")
    minimizers.build_index(spark, spark.createDataFrame(refs, "read_id string, sequence1 string"), path, 16, 8)
    sets = lambda s: set(minimizers.minimizers(s, 16, 8)[0].tolist())
    want = {}
    for q, s in reads[:-2]:
        for b, r in refs:
            score = max(len(x & sets(r.encode())) / len(x) for x in (sets(s.encode()), sets(minimizers.reverse_complement(s.encode()))))
            if score >= 0.2:
                want[q, b] = score
    q = spark.createDataFrame(reads, "read_id string, sequence1 string")
    for block in (1 << 22, 100, 1):  # one block; blocks and a bucket that is joined; all joined
        monkeypatch.setattr(minimizers, "BLOCK", block)
        found = minimizers.classify(spark, path, q, threshold=0.2)
        got = [(x.read_id, x.bucket_name, x.score) for x in found.collect()]
        assert len(got) == len(want) and {(a, b): s for a, b, s in got} == want
        if block == 1 << 22:  # shared minimizers are counted in the task, not joined and shuffled one by one
            assert "hits" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_index_is_written_by_tasks(spark, tmp_path, monkeypatch):
    def refuse(*_):
        raise AssertionError("subjects on the driver")

    rnd = random.Random(15)
    refs = [(f"r{i % 7}", "".join(rnd.choice("ACGT") for _ in range(100))) for i in range(30)]
    path = str(tmp_path / "x.mmi")
    monkeypatch.setattr(align, "MOST_SUBJECT_BASES", 2999)
    monkeypatch.setattr(type(spark.range(1)), "toArrow", refuse)
    assert align.save_minimap2_index(spark, spark.createDataFrame(refs, "read_id string, sequence1 string").repartition(5), path).first().num_subjects == 30
    subjects, seeds, p = align.open_index(spark, path)
    rows = subjects.orderBy("subject").collect()
    assert [r.subject for r in rows] == list(range(30)) and [r.name for r in rows] == sorted(n for n, _ in refs) and p == {"k": 21, "w": 11}
    want = align.Index([(r.name, r.sequence) for r in rows], 21, 11)
    assert sorted((r.subject, r.place) for r in seeds.collect()) == sorted(zip(want.subject.tolist(), want.place.tolist()))
    with pytest.raises(ValueError, match="align in shards"):
        align.load_index(spark, path)


def test_costs_tell_what_to_trace(monkeypatch):
    rnd = random.Random(16)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    changed = lambda s, rate: "".join(c if rnd.random() > rate else rnd.choice(["", "A", c + "GT"]) for c in s)
    for n in (1, 40, 260):
        q = text(n)
        subjects = [text(rnd.randint(0, 40)) + changed(q, rnd.random() / 2) + text(rnd.randint(0, 40)) for _ in range(40)] + ["", "A", q, q[: n // 2] + text(30) + q[n // 2 :]]
        want = [min(cost, align.MATCH * n) for cost, *_ in align.extend_all(q, subjects)]
        assert align.least_costs([q.encode()] * len(subjects), [s.encode() for s in subjects]).tolist() == want
    # of 200 places with a seed of the read, those are traced that are wanted
    repeat, read = text(40), text(150)
    read = repeat + read[40:]
    refs = [(f"r{i:03}", text(60) + (changed(read, 0.05) if i < 9 else repeat + text(110)) + text(60)) for i in range(200)]
    index, traced, extend = align.Index(refs, 15, 5), [], align._extend
    monkeypatch.setattr(align, "_extend", lambda q, subjects: traced.extend(subjects) or extend(q, subjects))
    found = align.align_read(index, read)
    every = sorted((-(300 - cost), name) for (name, s), (cost, *_) in zip(refs, align.extend_all(read, [s for _, s in refs])))
    assert len(align.candidates(index, read)) >= 190 and [(-a["score"], a["reference"]) for a in found] == every[:6]
    del traced[:]
    assert align.align_read(index, read) == found and len(traced) <= 12


def test_one_shard_with_most_reads(spark, tmp_path):
    rnd = random.Random(11)
    refs = [(f"r{i}", "".join(rnd.choice("ACGT") for _ in range(300))) for i in range(4)]
    for i in range(4):
        align.save_minimap2_index(spark, spark.createDataFrame(refs[i : i + 1], "read_id string, sequence1 string"), f"{tmp_path}/s{i}.mmi")
    reads = [(f"q{i}", refs[0 if i % 10 else i // 10 % 4][1][i % 100 : i % 100 + 120]) for i in range(200)]
    to = [(f"q{i}", f"s{0 if i % 10 else i // 10 % 4}") for i in range(200)]
    got = align.align_minimap2_sharded(spark, spark.createDataFrame(reads, "read_id string, sequence1 string"), str(tmp_path), spark.createDataFrame(to, "read_id string, shard_name string"), max_secondary=0).collect()
    assert sorted((r.read_id, r.reference, r.position, r.cigar) for r in got) == sorted((f"q{i}", f"r{0 if i % 10 else i // 10 % 4}", i % 100 + 1, "120=") for i in range(200))


def test_extend_is_optimal():
    rnd = np.random.default_rng(8)
    for _ in range(40):
        q, s = ("".join(rnd.choice(list("ACGT"), n)) for n in (12, 20))
        cost, start, end, ops = align.extend(q, s)
        best = min(_cost(q, s[a:b]) for a in range(21) for b in range(a, 21))
        assert cost == best and sum(o in "=XD" for o in ops) == end - start


def test_extension_side_by_side(monkeypatch):
    rnd = random.Random(12)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    q = text(60)
    changed = lambda: "".join(c if rnd.random() < 0.9 else rnd.choice(["", "A", c + "G"]) for c in q)
    subjects = [text(rnd.randint(0, 40)) + changed() + text(rnd.randint(0, 40)) for _ in range(30)] + ["", "A", q, "TT" + q + q]
    one = [align.extend(q, s) for s in subjects]
    assert align.extend_all(q, subjects) == one
    monkeypatch.setattr(align, "EXTENDED", 7)
    assert align.extend_all(q, subjects) == one
    for (cost, start, end, ops), s in zip(one, subjects):
        at, there, paid, last = 0, start, 0, ""
        for o in ops:
            if o in "=X":
                assert (q[at] == s[there]) == (o == "=")
            paid += {"=": 0, "X": align.MATCH + align.MISMATCH, "I": align.MATCH + align.GAP_EXTEND, "D": align.GAP_EXTEND}[o] + align.GAP_OPEN * (o in "ID" and o != last)
            at, there, last = at + (o in "=XI"), there + (o in "=XD"), o
        assert (at, there, paid) == (len(q), end, cost)


def _cost(q, s):
    from lichenmill.functions.pairwise import align as exact

    # inserted bases also lose their match, so the matching penalties are moved onto them
    x, ops = exact(q, s, align.MATCH + align.MISMATCH, align.GAP_OPEN, align.GAP_EXTEND)
    best = x + ops.count("I") * align.MATCH
    return best if "I" not in ops else min(best, _dp(q, s))


def _dp(q, s):
    inf = 10**9
    n, m = len(q), len(s)
    h = [[inf] * (m + 1) for _ in range(n + 1)]
    i_, d = [r[:] for r in h], [r[:] for r in h]
    for i in range(n + 1):
        for j in range(m + 1):
            if i:
                i_[i][j] = min(h[i - 1][j] + align.GAP_OPEN, i_[i - 1][j]) + align.GAP_EXTEND + align.MATCH
            if j:
                d[i][j] = min(h[i][j - 1] + align.GAP_OPEN, d[i][j - 1]) + align.GAP_EXTEND
            t = 0 if i == j == 0 else h[i - 1][j - 1] + (q[i - 1] != s[j - 1]) * (align.MATCH + align.MISMATCH) if i and j else inf
            h[i][j] = min(t, i_[i][j], d[i][j])
    return h[n][m]


def test_repeated_loci():
    import random

    from lichenmill.operators import align

    rnd = random.Random(3)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    read = text(150)
    worse = read[:70] + ("A" if read[70] != "A" else "C") + read[71:]
    subject = text(300) + read + text(300) + worse + text(300) + align.reverse_complement(read) + text(300)
    index = align.Index([("s", subject)], 21, 11)
    found = align.align_read(index, read)
    assert [(a["position"], a["reverse"], a["nm"]) for a in found] == [(301, False, 0), (1201, True, 0), (751, False, 1)]
    rows = align._single("r", found)
    assert [r["flags"] for r in rows] == [0, 0x110, 0x100] and rows[0]["mapq"] == 0 and rows[0]["tag_xs"] == 300
    only = align._single("r", align.align_read(index, read, max_secondary=0))
    assert len(only) == 1 and only[0]["tag_xs"] == 300 and only[0]["mapq"] == 0
    # the best subject has fewer seeds than many others
    many = [(f"m{i}", text(40) + read[:100] + text(90)) for i in range(9)]
    spread = "".join(c if i % 23 or not i else "ACGT"[("ACGT".index(c) + 1) % 4] for i, c in enumerate(read))
    found = align.align_read(align.Index([*many, ("best", text(40) + spread + text(40))], 15, 5), read, max_secondary=0)
    assert found[0]["reference"] == "best"


def test_strand_minimizers_read_whole_texts(spark, tmp_path):
    import random

    from lichenmill.operators import minimizers
    from lichenmill.plans import registry

    rnd = random.Random(4)
    text = "-" * 400 + "".join(rnd.choice("ACGT") for _ in range(3000))
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = registry.queries()["t8_strand_minimizers"](spark, str(tmp_path)).first()
    want = [len(minimizers.minimizers(x, 16, 8)[0]) for x in (text[400:].encode(), minimizers.reverse_complement(text[400:].encode()))]
    assert [row.n_fwd, row.n_rc] == want and min(want) > 300


def test_places_of_many_reads_together(monkeypatch):
    rnd = random.Random(17)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    shared = text(60)
    refs = [(f"r{i % 9}", text(rnd.randint(0, 80)) + (shared if i % 2 else "") * (i % 4) + text(70)) for i in range(30)]
    reads = [s[i : i + 90] for i, (_, s) in enumerate(refs)] + [align.reverse_complement(s[:80]) for _, s in refs[:5]] + ["", "ACG", shared, shared[:20], "N" * 50, shared[:30] + "N" + shared[30:]]
    index = align.Index(refs, 15, 5)
    want = []
    for read in reads:
        found = []
        for turned, one in ((False, read), (True, align.reverse_complement(read))):
            counts = {}
            for h, i in zip(*(x.tolist() for x in align._seeds(one, 15, 5))):
                for at in (index.hashes == h).nonzero()[0].tolist():
                    key = int(index.subject[at]), (int(index.place[at]) - i) // 32
                    counts[key] = counts.get(key, 0) + 1
            taken = set()
            for s, d in sorted(counts):
                if (s, d - 1) not in taken:
                    taken.add((s, d))
                    found.append((s, d * 32, turned, counts[s, d] + counts.get((s, d + 1), 0)))
        want.append(sorted(found, key=lambda f: (-f[3], f[0], f[2], f[1])))
    assert sum(map(len, want)) > 300
    for most, hits in ((1 << 8, 1 << 15), (7, 50), (1, 1)):
        monkeypatch.setattr(align, "READS_AT_ONCE", most)
        monkeypatch.setattr(align, "HITS_AT_ONCE", hits)
        assert list(align.candidates_of(index, reads)) == want
    assert list(align.align_reads(index, reads)) == [align.align_read(index, r) for r in reads]


def test_traces_of_many_reads_together(monkeypatch):
    rnd = random.Random(18)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    queries = [text(50) for _ in range(40)]
    subjects = [text(rnd.randint(0, 30)) + q[: i % 50] + text(i % 7) + q[i % 50 + i % 5 :] + text(rnd.randint(0, 30)) for i, q in enumerate(queries)]
    one = [align.extend(q, s) for q, s in zip(queries, subjects)]
    inexact = [k for k, (q, s) in enumerate(zip(queries, subjects)) if q not in s]
    assert align.extend_pairs([queries[k].encode() for k in inexact], [subjects[k].encode() for k in inexact]) == [one[k] for k in inexact]
    # 40 reads that each have one place to trace take one matrix, not 40
    read = [text(150) for _ in range(40)]
    index = align.Index([(f"r{i:02}", text(60) + r[:70] + ("A" if r[70] != "A" else "C") + r[71:] + text(60)) for i, r in enumerate(read)], 15, 5)
    calls, extend = [], align._extend
    monkeypatch.setattr(align, "_extend", lambda q, s: calls.append(len(s)) or extend(q, s))
    assert [a[0]["cigar"] for a in align.align_reads(index, read)] == ["70=1X79="] * 40
    assert sum(calls) == 40 and len(calls) <= 2


def test_few_reads_are_many_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    rnd = random.Random(19)
    refs = [(f"r{i}", "".join(rnd.choice("ACGT") for _ in range(300))) for i in range(3)]
    for i in range(3):
        align.save_minimap2_index(spark, spark.createDataFrame(refs[i : i + 1], "read_id string, sequence1 string"), f"{tmp_path}/s{i}.mmi")
    of = [0 if i % 10 else i // 10 % 3 for i in range(150)]
    reads = spark.createDataFrame([(f"q{i}", refs[k][1][i % 100 : i % 100 + 120]) for i, k in enumerate(of)], "read_id string, sequence1 string")
    to = spark.createDataFrame([(f"q{i}", f"s{k}") for i, k in enumerate(of)], "read_id string, shard_name string")
    got = align.align_minimap2_sharded(spark, reads, str(tmp_path), to, max_secondary=0).select("read_id", "reference", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.read_id, r.reference) for r in got) == sorted((f"q{i}", f"r{k}") for i, k in enumerate(of))
    # small reads were merged into one task, however long they take
    assert len({r.task for r in got}) > spark.sparkContext.defaultParallelism
    assert sum(len({r.reference for r in got if r.task == t}) > 1 for t in {r.task for r in got}) <= 2


def test_unsharded_index_stays_out_of_the_driver(spark, tmp_path, monkeypatch):
    rnd = random.Random(21)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    shared = text(150)
    changed = lambda s, n: "".join("ACGT"["ACGT".index(c) ^ 1] if i % 30 < n else c for i, c in enumerate(s))
    # places of equal scores in many parts, and two subjects of one name
    refs = [(f"r{i:02}", text(120) + (shared if i % 5 == 0 else changed(shared, i % 3)) + text(120)) for i in range(16)]
    refs += [("r07", text(80) + shared + text(60)), ("s", text(400)), ("t", refs[3][1])]
    reads = {f"q{i:02}": s[100:250] for i, (_, s) in enumerate(refs) if i % 4 == 0} | {"one": shared, "back": align.reverse_complement(shared), "none": text(150), "short": shared[:25]}
    subjects, queries = spark.createDataFrame(refs, "read_id string, sequence1 string"), spark.createDataFrame(list(reads.items()), "read_id string, sequence1 string")
    pairs = spark.createDataFrame([("p", shared, align.reverse_complement(refs[1][1][:150])), ("lost", text(150), text(150)), ("alone", shared, None)], "read_id string, sequence1 string, sequence2 string")
    path = str(tmp_path / "i.mmi")
    align.save_minimap2_index(spark, subjects, path)
    frame = type(spark.range(0))
    no = lambda *_: pytest.fail("rows pass through the driver")
    monkeypatch.setattr(align, "MOST_SUBJECT_BASES", 2999)  # of a shard or a part, not of the whole
    monkeypatch.setattr(align, "PART_BASES", 1200)
    monkeypatch.setattr(align, "PART_AIM", 4000)
    for way in ("toArrow", "toPandas"):
        monkeypatch.setattr(frame, way, no)
    order = sorted(refs, key=lambda r: r[0])
    whole = align.Index(order, 21, 11)
    want = sorted((name, a["reference"], a["position"], a["cigar"], a["score"], a.get("second", 0) if not i else 0) for name, s in reads.items() for i, a in enumerate(align.align_read(whole, s)))
    assert len({w[1] for w in want}) >= 8 and max(Counter(w[0] for w in want).values()) == 6
    rows = lambda df: sorted((r.read_id, r.reference, r.position, r.cigar, r.tag_as, r.tag_xs or 0) for r in df.collect())
    assert rows(align.align_minimap2(spark, queries, subjects)) == want
    assert rows(align.align_minimap2(spark, queries, index_path=path)) == want
    both = [r for name, one, two in [("p", shared, align.reverse_complement(refs[1][1][:150])), ("alone", shared, None)] for r in (align.align_pair(whole, name, one, two, 5, True) if two else align._single(name, align.align_read(whole, one)))]
    tell = lambda r: (r["read_id"], r["flags"], r["reference"], r["position"], r["cigar"], r["mate_reference"], r["mate_position"], r["template_length"], r["tag_yt"])
    assert sorted(map(tell, align.align_minimap2(spark, pairs, subjects).collect())) == sorted(map(tell, both))
    few = {name: reads[name] for name in ("q04", "one", "none")}
    queries = spark.createDataFrame(list(few.items()), "read_id string, sequence1 string")
    each = [(name, a["reference"], a["position"], a["cigar"], a["score"]) for name, s in few.items() for r in refs for a in align.align_read(align.Index([r], 21, 11), s)]
    assert sorted(r[:5] for r in rows(align.align_minimap2(spark, queries, subjects, per_subject_database=True))) == sorted(each)


def test_places_that_cost_too_much_are_left_out(monkeypatch):
    rnd = random.Random(22)
    text = lambda n: "".join(rnd.choice("ACGT") for _ in range(n))
    read = text(150)
    changed = lambda n: "".join(rnd.choice(["", "A", c + "GT"]) if rnd.random() < n else c for c in read)
    # the pieces' bound is never over the cost
    for rate in (0.01, 0.05, 0.2):
        for s in [text(20) + changed(rate) + text(20) for _ in range(60)] + [read[:a] + read[b:] + text(9) for a, b in ((30, 31), (30, 60), (6, 100))]:
            pieces = [read[i : i + align.PIECE] for i in range(0, 150 - align.PIECE + 1, align.PIECE)]
            assert sum(x not in s for x in pieces) * align.PIECE_COST <= align.extend(read, s)[0]
    # of 300 places those that have only the seed are not costed once six good ones are known
    refs = [(f"r{i:03}", text(60) + (changed(0.02) if i % 10 == 0 else read[:40] + text(110)) + text(60)) for i in range(300)]
    index, costed, least = align.Index(refs, 15, 5), [], align.least_costs
    monkeypatch.setattr(align, "least_costs", lambda q, s: costed.extend(s) or least(q, s))
    found = align.align_read(index, read)
    every = sorted((cost - 300, name) for (name, s), (cost, *_) in zip(refs, align.extend_all(read, [s for _, s in refs])))
    assert [(-a["score"], a["reference"]) for a in found] == every[:6] and len(align.candidates(index, read)) >= 290 and len(costed) <= 100
