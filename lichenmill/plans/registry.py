"""Queries over the driver's tables, one or more for each operator, and their SQL.

The tables hold no sequences, so inputs are derived from them by plain expressions that the SQL
repeats: flags from keys, CIGARs from numbers, nucleotides from texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lichenmill import __version__
from lichenmill.functions import cigar, flags, misc, pairwise, quality, sequences
from lichenmill.operators import align, analysis, intervals, minimizers, tree
from lichenmill.scratch import scratch_path, scratch_table
from lichenmill.ship import ship
from lichenmill.sources import biom, fastx, newick, sam, sff, sinks, text

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- F1 to F13: flags ----------------------------------------------------------------------------


def _flag_query(i: int, name: str, sql: str) -> None:
    f = flags.PREDICATES[name]

    def run(spark, sf):
        rows = _t(spark, sf, "lineitem").select("l_suppkey", f((F.col("l_partkey") % 4096).cast("int")).alias("hit"))
        return rows.groupBy("l_suppkey").agg(F.count_if("hit").alias("n_true"), F.count("*").alias("n"))

    query(f"f{i}_{name}", f"SELECT l_suppkey, count(*) FILTER ({sql}) AS n_true, count(*) AS n FROM lineitem GROUP BY l_suppkey")(run)


for _i, (_name, (_mask, _short)) in enumerate(flags.BITS.items(), 1):
    _no = _i if _i < 10 else _i + 1  # the primary test is the tenth
    _flag_query(_no, _name, f"(l_partkey % 4096) & {_mask} <> 0")
_flag_query(10, "alignment_is_primary", "(l_partkey % 4096) & 2304 = 0")


@query(
    "f1_f13_short_names",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"(l_partkey % 4096) & {m} <> 0 AS {s}" for m, s in flags.BITS.values())
    + " FROM lineitem",
)
def _short_names(spark, sf):
    flag = (F.col("l_partkey") % 4096).cast("int")
    return _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[flags.PREDICATES[s](flag).alias(s) for _, s in flags.BITS.values()])


# --- F14 to F18: CIGAR and MD --------------------------------------------------------------------

_CIGAR_SQL = """
WITH x AS (SELECT l_orderkey, l_linenumber, l_linenumber::BIGINT AS s, l_quantity::BIGINT AS m, l_suppkey % 7 + 1 AS i, l_partkey % 5 + 1 AS d,
                  l_partkey % 3 + 1 AS h, l_partkey % 4 AS nm FROM lineitem)
"""


def _cigars(spark, sf) -> DataFrame:
    n = lambda c: c.cast("bigint").cast("string")
    li = _t(spark, sf, "lineitem")
    s, m = n(F.col("l_linenumber")), n(F.col("l_quantity"))
    i, d, h = n(F.col("l_suppkey") % 7 + 1), n(F.col("l_partkey") % 5 + 1), n(F.col("l_partkey") % 3 + 1)
    text_ = F.concat(h, F.lit("H"), s, F.lit("S"), m, F.lit("M"), i, F.lit("I"), m, F.lit("="), d, F.lit("D"), i, F.lit("X"), s, F.lit("S"))
    nm = F.col("l_suppkey") % 7 + 1 + F.col("l_partkey") % 5 + 1 + F.col("l_partkey") % 4
    md = F.concat(m, F.lit("A"), i, F.lit("^ACGT"), d, F.lit("T"), m)
    return _spread(li).select("l_orderkey", "l_linenumber", text_.alias("cigar"), nm.alias("nm"), md.alias("md"))


for _kind, _sql in (
    ("gap_excluded", "(2 * m + i + d)::DOUBLE / (2 * m + i + d + 2)"),
    ("blast", "(2 * m + i + i + d - (i + d + nm))::DOUBLE / (2 * m + i + i + d)"),
    ("gap_compressed", "(2 * m + i - (i + d + nm) + i + d)::DOUBLE / (2 * m + i + 2)"),
):

    def _identity(spark, sf, kind=_kind):
        return _cigars(spark, sf).select("l_orderkey", "l_linenumber", F.round(cigar.alignment_seq_identity("cigar", "nm", "md", kind), 9).alias("identity"))

    query(f"f14_seq_identity_{_kind}", _CIGAR_SQL + f"SELECT l_orderkey, l_linenumber, round({_sql}, 9) AS identity FROM x")(_identity)


@query("f15_query_length", _CIGAR_SQL + "SELECT l_orderkey, l_linenumber, 2 * s + 2 * m + 2 * i + h AS with_hard, 2 * s + 2 * m + 2 * i AS without_hard FROM x")
def _query_length(spark, sf):
    return _cigars(spark, sf).select(
        "l_orderkey", "l_linenumber", cigar.alignment_query_length("cigar").alias("with_hard"), cigar.alignment_query_length("cigar", False).alias("without_hard")
    )


@query(
    "f16_query_coverage",
    _CIGAR_SQL
    + "SELECT l_orderkey, l_linenumber, round((2 * m + i)::DOUBLE / (2 * s + 2 * m + 2 * i + h), 9) AS aligned, round((2 * m + 2 * i)::DOUBLE / (2 * s + 2 * m + 2 * i + h), 9) AS mapped FROM x",
)
def _query_coverage(spark, sf):
    return _cigars(spark, sf).select(
        "l_orderkey",
        "l_linenumber",
        F.round(cigar.alignment_query_coverage("cigar"), 9).alias("aligned"),
        F.round(cigar.alignment_query_coverage("cigar", "mapped"), 9).alias("mapped"),
    )


@query("f17_cigar_parts", _CIGAR_SQL + "SELECT l_orderkey, l_linenumber, 2::BIGINT AS gap_opens, i + d AS gap_bases, 2 * m + i AS aligned, 2 * m + i + d AS span FROM x")
def _cigar_parts(spark, sf):
    g = cigar.Cigar(F.col("cigar"))
    return _cigars(spark, sf).select(
        "l_orderkey", "l_linenumber", g.gap_opens().alias("gap_opens"), g.total("ID").alias("gap_bases"), g.total("M=X").alias("aligned"), g.total("M=XDN").alias("span")
    )


@query("f18_md_counts", _CIGAR_SQL + "SELECT l_orderkey, l_linenumber, 2 * m + i + d AS matches, 2::BIGINT AS mismatches FROM x")
def _md(spark, sf):
    a, b = cigar.md_counts(F.col("md"))
    return _cigars(spark, sf).select("l_orderkey", "l_linenumber", a.alias("matches"), b.alias("mismatches"))


# --- F19 to F23: nucleotides ---------------------------------------------------------------------

_DNA_SQL = "WITH dna AS (SELECT doc_id, regexp_replace(text, '[^ACGTacgt]', '', 'g') AS s FROM documents) "


def _dna(spark, sf, letters: str = "ACGTacgt") -> DataFrame:
    """doc_id, s: the nucleotide letters of a whole text: how this table gets sequences at all."""
    return _t(spark, sf, "documents").select("doc_id", F.regexp_replace("text", f"[^{letters}]+", "").alias("s"))


def _spread(df: DataFrame) -> DataFrame:
    """Rows of a table in few row groups over all cores, ahead of dear functions."""
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism)


@query("f19_dna_reverse_complement", _DNA_SQL + "SELECT doc_id, translate(reverse(s), 'ACGTacgt', 'TGCAtgca') AS rc FROM dna")
def _rc(spark, sf):
    return _dna(spark, sf).select("doc_id", sequences.sequence_dna_reverse_complement("s").alias("rc"))


@query("f20_rna_reverse_complement", _DNA_SQL + "SELECT doc_id, translate(reverse(translate(s, 'Tt', 'Uu')), 'ACGUacgu', 'UGCAugca') AS rc FROM dna")
def _rna_rc(spark, sf):
    return _dna(spark, sf).select("doc_id", sequences.sequence_rna_reverse_complement(F.translate("s", "Tt", "Uu")).alias("rc"))


_EXPAND = "s"
for _k, _v in sequences.DNA_BASES.items():
    _EXPAND = f"replace(replace({_EXPAND}, '{_k}', '[{_v}]'), '{_k.lower()}', '[{_v.lower()}]')"
_IUPAC_SQL = "WITH dna AS (SELECT doc_id, regexp_replace(text, '[^ACGTRYSWKMBDHVNacgtryswkmbdhvn]', '', 'g') AS s FROM documents) "


@query("f21_dna_as_regexp", _IUPAC_SQL + f"SELECT doc_id, {_EXPAND} AS pattern FROM dna")
def _dna_pattern(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^ACGTRYSWKMBDHVNacgtryswkmbdhvn]", "").alias("s"))
    return rows.select("doc_id", sequences.sequence_dna_as_regexp("s").alias("pattern"))


@query("f22_rna_as_regexp", _IUPAC_SQL + f"SELECT doc_id, translate({_EXPAND}, 'Tt', 'Uu') AS pattern FROM dna")
def _rna_pattern(spark, sf):
    rows = _t(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^ACGTRYSWKMBDHVNacgtryswkmbdhvn]", "").alias("s"))
    return rows.select("doc_id", sequences.sequence_rna_as_regexp(F.translate("s", "Tt", "Uu")).alias("pattern"))


@query("f23_regexp_match", _DNA_SQL + "SELECT doc_id, regexp_matches(s, '[AG][CT]a[ACGTacgt]t') AS hit FROM dna")
def _match(spark, sf):
    return _dna(spark, sf).select("doc_id", F.col("s").rlike("[AG][CT]a[ACGTacgt]t").alias("hit"))


# --- F24 to F26: pairwise alignment --------------------------------------------------------------


_PIECE = 100
_PAIR_SQL = _DNA_SQL + f""", pieces AS (
  SELECT doc_id, no, substr(s, 1 + no * {_PIECE}, {_PIECE}) AS q, substr(s, 7 + no * {_PIECE}, {_PIECE}) AS shifted
  FROM (SELECT doc_id, s, unnest(range((length(s) + {_PIECE - 1}) // {_PIECE})) AS no FROM dna)),
pairs AS (
  SELECT *, length(q) AS n, length(q) // 2 AS k,
    substr(q, 1, length(q) // 2) || translate(substr(q, length(q) // 2 + 1, 1), 'ACGTacgt', 'CGTAcgta') || substr(q, length(q) // 2 + 2) AS changed FROM pieces)
"""


def _pairs(spark, sf) -> DataFrame:
    """doc_id, no, q, shifted, changed: every stretch of _PIECE letters of a text's sequence, the stretch six letters on, and q with one other letter."""
    n = F.floor((F.length("s") + _PIECE - 1) / _PIECE)
    each = _dna(spark, sf).where("s <> ''").select("doc_id", "s", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("no"))
    part = lambda first: F.substring("s", (F.col("no") * _PIECE + first).cast("int"), F.lit(_PIECE))
    rows = _spread(each.select("doc_id", F.col("no").cast("bigint"), part(1).alias("q"), part(7).alias("shifted")))
    half = F.floor(F.length("q") / 2).cast("int")
    other = F.translate(F.substring("q", half + 1, F.lit(1)), "ACGTacgt", "CGTAcgta")
    return rows.withColumn("changed", F.concat(F.substring("q", F.lit(1), half), other, F.substring("q", half + 2, F.lit(_PIECE))))


@query("f24_pairwise_edit_distance", _PAIR_SQL + "SELECT doc_id, no, levenshtein(q, shifted)::INT AS score FROM pairs")
def _edit(spark, sf):
    return _pairs(spark, sf).select("doc_id", "no", pairwise.align_pairwise_score("q", "shifted", mismatch=1, gap_open=0, gap_extend=1).alias("score"))


# One letter changed costs one mismatch, and anything else a gap at the least; one letter lost costs one gap.
@query(
    "f25_pairwise_cigar",
    _PAIR_SQL
    + """SELECT doc_id, no, 4 AS score, CASE WHEN k > 0 THEN k || '=' ELSE '' END || '1X' || CASE WHEN n - k - 1 > 0 THEN (n - k - 1) || '=' ELSE '' END AS cigar,
         8 AS lost FROM pairs""",
)
def _pair_cigar(spark, sf):
    lost = F.substring("q", F.lit(2), F.lit(_PIECE))
    rows = _pairs(spark, sf).select("doc_id", "no", pairwise.align_pairwise_cigar("q", "changed").alias("x"), pairwise.align_pairwise_score("q", lost).alias("lost"))
    return rows.select("doc_id", "no", "x.score", "x.cigar", "lost")


@query(
    "f26_pairwise_full",
    _PAIR_SQL + "SELECT doc_id, no, 4 AS score, q AS query_aligned, changed AS subject_aligned, q AS query, shifted AS subject, true AS fits FROM pairs",
)
def _pair_full(spark, sf):
    rows = _pairs(spark, sf).select("doc_id", "no", pairwise.align_pairwise_full("q", "changed").alias("x"), pairwise.align_pairwise_full("q", "shifted").alias("y"))
    bare = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    return rows.select(
        "doc_id",
        "no",
        "x.score",
        "x.query_aligned",
        "x.subject_aligned",
        bare(F.col("y.query_aligned")).alias("query"),
        bare(F.col("y.subject_aligned")).alias("subject"),
        (F.length("y.query_aligned") == F.length("y.subject_aligned")).alias("fits"),
    )


# --- F27, F28, F33 to F36 ------------------------------------------------------------------------


@query("f27_engine_version", f"SELECT '{__version__}' AS version")
def _version(spark, sf):
    return spark.range(1).select(misc.engine_version().alias("version"))


@query("f28_bowtie2_available")
def _bowtie2(spark, sf):
    return spark.range(1).select(F.lit(misc.bowtie2_available()).alias("available"))


@query("f33_gff_attributes", "SELECT o_orderkey, o_orderkey::VARCHAR AS id, o_orderpriority AS name, NULL::VARCHAR AS flag FROM orders")
def _attributes(spark, sf):
    text_ = F.concat(F.lit("ID="), F.col("o_orderkey").cast("string"), F.lit("=lost;Name="), F.col("o_orderpriority"), F.lit(";flag"))
    a = misc.parse_gff_attributes(text_)
    return _t(spark, sf, "orders").select("o_orderkey", a["ID"].alias("id"), a["Name"].alias("name"), a["flag"].alias("flag"))


@query("f34_quality_strings", "SELECT l_orderkey, l_linenumber, chr((33 + l_partkey % 94)::INT) || chr((33 + l_suppkey % 94)::INT) AS text, l_partkey % 94 AS first, l_suppkey % 94 AS second FROM lineitem")
def _quality(spark, sf):
    scores = F.array((F.col("l_partkey") % 94).cast("smallint"), (F.col("l_suppkey") % 94).cast("smallint"))
    rows = _t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", quality.encode_quality(scores).alias("text"))
    back = quality.decode_quality(F.col("text"))
    return rows.select("l_orderkey", "l_linenumber", "text", F.get(back, F.lit(0)).cast("bigint").alias("first"), F.get(back, F.lit(1)).cast("bigint").alias("second"))


@query(
    "f35_low_quality_window",
    """SELECT o_orderkey, CASE WHEN a < 20 AND b < 20 THEN 0 WHEN b < 20 AND c < 20 THEN 1 WHEN c < 20 AND d < 20 THEN 2 ELSE 5 END::INT AS at
       FROM (SELECT o_orderkey, o_orderkey % 41 AS a, o_custkey % 37 AS b, (o_orderkey + o_custkey) % 31 AS c, (o_orderkey * 3) % 29 AS d FROM orders)""",
)
def _window(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    scores = F.array(*[x.cast("int") for x in (k % 41, c % 37, (k + c) % 31, (k * 3) % 29)])
    return _t(spark, sf, "orders").select("o_orderkey", quality.find_low_quality_window(scores, 20, 2).cast("int").alias("at"))


def _geography(spark, sf) -> DataFrame:
    """A tree of the world: regions, nations and customers below one root."""
    root = spark.range(1).select(F.lit(0).cast("bigint").alias("node_index"), F.lit("world").alias("name"), F.lit(None).cast("double").alias("branch_length"), F.lit(None).cast("bigint").alias("parent_index"))
    region = _t(spark, sf, "region").select((F.col("r_regionkey") + 1).cast("bigint"), "r_name", F.lit(1.0), F.lit(0).cast("bigint"))
    nation = _t(spark, sf, "nation").select((F.col("n_nationkey") + 100).cast("bigint"), "n_name", F.lit(2.0), (F.col("n_regionkey") + 1).cast("bigint"))
    customer = _t(spark, sf, "customer").select((F.col("c_custkey") + 1000).cast("bigint"), "c_name", (F.col("c_custkey") % 5).cast("double"), (F.col("c_nationkey") + 100).cast("bigint"))
    return root.union(region).union(nation).union(customer)


_TREE_SQL = """SELECT 0::BIGINT AS node_index, 'world' AS name, NULL::DOUBLE AS branch_length, NULL::BIGINT AS parent_index
UNION ALL SELECT r_regionkey + 1, r_name, 1.0, 0 FROM region
UNION ALL SELECT n_nationkey + 100, n_name, 2.0, n_regionkey + 1 FROM nation
UNION ALL SELECT c_custkey + 1000, c_name, (c_custkey % 5)::DOUBLE, c_nationkey + 100 FROM customer"""


@query(
    "f36_tree_metrics",
    f"""WITH RECURSIVE t AS ({_TREE_SQL}), walk AS (
        SELECT node_index, 0 AS depth, 0::DOUBLE AS distance_to_root FROM t WHERE parent_index IS NULL
        UNION ALL SELECT t.node_index, depth + 1, distance_to_root + coalesce(branch_length, 0) FROM t JOIN walk ON t.parent_index = walk.node_index)
        SELECT node_index, depth, distance_to_root FROM walk""",
)
def _metrics(spark, sf):
    return tree.depths(_geography(spark, sf))


@query("f36_tree_tips", f"SELECT node_index FROM ({_TREE_SQL}) t WHERE NOT EXISTS (FROM ({_TREE_SQL}) c WHERE c.parent_index = t.node_index)")
def _tips(spark, sf):
    return tree.tip_rows(_geography(spark, sf)).select("node_index")


@query(
    "f36_tree_distances",
    """SELECT x.c_custkey + 1000 AS a, y.c_custkey + 1000 AS b,
         CASE WHEN x.c_nationkey = y.c_nationkey THEN x.c_nationkey + 100 WHEN m.n_regionkey = n.n_regionkey THEN m.n_regionkey + 1 ELSE 0 END AS ancestor,
         (x.c_custkey % 5 + y.c_custkey % 5 + CASE WHEN x.c_nationkey = y.c_nationkey THEN 0 WHEN m.n_regionkey = n.n_regionkey THEN 4 ELSE 6 END)::DOUBLE AS distance
       FROM customer x JOIN customer y ON y.c_custkey = x.c_custkey + 1 JOIN nation m ON m.n_nationkey = x.c_nationkey JOIN nation n ON n.n_nationkey = y.c_nationkey""",
)
def _distances(spark, sf):
    c = _t(spark, sf, "customer")
    other = c.select(F.col("c_custkey").alias("next"))
    pairs = c.join(other, F.col("next") == F.col("c_custkey") + 1).select((F.col("c_custkey") + 1000).cast("bigint").alias("a"), (F.col("next") + 1000).cast("bigint").alias("b"))
    return tree.common_ancestors(_geography(spark, sf), pairs)


# --- A1 to A4 ------------------------------------------------------------------------------------

_ISLANDS = """
x AS (SELECT l_partkey AS k, l_orderkey AS a, l_orderkey + l_quantity::BIGINT AS b FROM lineitem),
m AS (SELECT *, max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM m),
merged AS (SELECT k, min(a) AS start, max(b) AS stop FROM g GROUP BY k, island)
"""


def _spans(spark, sf) -> DataFrame:
    return _t(spark, sf, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("bigint")).alias("stop"))


@query("a1_compress_intervals", f"WITH {_ISLANDS} SELECT k, start, stop FROM merged")
def _compress(spark, sf):
    return intervals.compress_intervals(_spans(spark, sf), "k")


@query("a1_compress_intervals_list", f"WITH {_ISLANDS} SELECT k, count(*) AS n, min(start) AS first, sum(stop - start)::BIGINT AS covered FROM merged GROUP BY k")
def _compress_list(spark, sf):
    rows = intervals.compress_intervals_list(_spans(spark, sf), "k")
    total = F.aggregate("intervals", F.lit(0).cast("bigint"), lambda a, x: a + x["stop"] - x["start"])
    return rows.select("k", F.size("intervals").cast("bigint").alias("n"), F.get("intervals", F.lit(0))["start"].alias("first"), total.alias("covered"))


def _reads(spark, sf) -> DataFrame:
    return _t(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("sample_id"), F.col("l_orderkey").alias("read_id"), F.col("l_partkey").alias("reference"), (F.col("l_linenumber") * 32).cast("int").alias("flags")
    )


@query(
    "a2_woltka_ogu",
    """WITH b AS (SELECT DISTINCT l_orderkey AS r, l_partkey AS f, (l_linenumber * 32) & 64 <> 0 AS m FROM lineitem),
       w AS (SELECT f, 1.0::DOUBLE / count(*) OVER (PARTITION BY r, m) AS w FROM b)
       SELECT f AS feature_id, round(sum(w), 6) AS value FROM w GROUP BY f""",
)
def _ogu(spark, sf):
    return analysis.woltka_ogu(_reads(spark, sf)).select("feature_id", F.round("value", 6).alias("value"))


@query(
    "a3_woltka_ogu_per_sample",
    """WITH b AS (SELECT DISTINCT l_suppkey AS s, l_orderkey AS r, l_partkey AS f, (l_linenumber * 32) & 64 <> 0 AS m FROM lineitem),
       w AS (SELECT s, f, 1.0::DOUBLE / count(*) OVER (PARTITION BY r, m) AS w FROM b)
       SELECT s AS sample_id, f AS feature_id, round(sum(w), 6) AS value FROM w GROUP BY s, f""",
)
def _ogu_sample(spark, sf):
    return analysis.woltka_ogu_per_sample(_reads(spark, sf)).select("sample_id", "feature_id", F.round("value", 6).alias("value"))


@query(
    "a4_genome_coverage",
    f"""WITH {_ISLANDS}, c AS (SELECT p_brand AS genome_id, sum(stop - start)::BIGINT AS covered FROM merged JOIN part ON k = p_partkey GROUP BY p_brand),
        t AS (SELECT p_brand AS genome_id, sum(p_size)::BIGINT * 1000 AS total_length FROM part GROUP BY p_brand)
        SELECT genome_id, covered, round(covered::DOUBLE / total_length, 9) AS proportion_covered FROM c JOIN t USING (genome_id)""",
)
def _coverage(spark, sf):
    part = _t(spark, sf, "part")
    totals = part.groupBy(F.col("p_brand").alias("genome_id")).agg((F.sum("p_size") * 1000).alias("total_length"))
    contigs = part.select(F.col("p_partkey").alias("contig_id"), F.col("p_brand").alias("genome_id"))
    spans = _spans(spark, sf).toDF("reference", "position", "stop_position")
    return analysis.genome_coverage(spans, totals, contigs).select("genome_id", "covered", F.round("proportion_covered", 9).alias("proportion_covered"))


# --- S and K: scans and sinks, by writing files and reading them back ---------------------------


def _records(spark, sf) -> DataFrame:
    s = F.upper(F.col("s"))
    return _dna(spark, sf).where(F.length("s") > 0).select(
        F.concat(F.lit("r"), F.col("doc_id").cast("string")).alias("read_id"),
        F.lit("c").alias("comment"),
        s.alias("sequence1"),
        F.transform(F.sequence(F.lit(1), F.length("s")), lambda i: (i % 41).cast("smallint")).alias("qual1"),
    )


_RECORD_SQL = _DNA_SQL + "SELECT 'r' || doc_id AS read_id, {comment} AS comment, upper(s) AS sequence1, {n} FROM dna WHERE length(s) > 0"
_QUAL_SQL = "length(s)::INT AS n_qual, list_sum(list_transform(range(1, length(s) + 1), lambda i: (i % 41) * (i % 7 + 1)))::BIGINT AS weighed"


@query("s1_k1_fastq_round_trip", _RECORD_SQL.format(comment="'c'", n=_QUAL_SQL))
def _fastq(spark, sf):
    path = scratch_path(spark, "x.fq.gz")
    sinks.write_fastq(_records(spark, sf), path, include_comment=True)
    each = F.transform("qual1", lambda q, i: q.cast("bigint") * ((i + 1) % 7 + 1))  # every score and its place
    weighed = F.aggregate(each, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("weighed")
    return fastx.read_fastx(spark, path).select("read_id", "comment", "sequence1", F.size("qual1").alias("n_qual"), weighed)


@query("s1_k2_fasta_round_trip", _RECORD_SQL.format(comment="NULL::VARCHAR", n="NULL::INT AS n_qual"))
def _fasta(spark, sf):
    path = scratch_path(spark, "x.fa")
    sinks.write_fasta(_records(spark, sf), path)
    return fastx.read_fastx(spark, path).select("read_id", "comment", "sequence1", F.when(F.col("qual1").isNotNull(), F.size("qual1")).alias("n_qual"))


def _alignments(spark, sf) -> DataFrame:
    li = _t(spark, sf, "lineitem")
    return li.select(
        F.concat_ws("_", "l_orderkey", "l_linenumber").alias("read_id"),
        F.lit(0).alias("flags"),
        F.concat(F.lit("g"), (F.col("l_suppkey") % 10).cast("string")).alias("reference"),
        (F.col("l_partkey") + 1).alias("position"),
        F.lit(60).cast("smallint").alias("mapq"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("M3D2I5M")).alias("cigar"),
        F.lit("*").alias("mate_reference"),
        F.lit(0).cast("bigint").alias("mate_position"),
        F.lit(0).cast("bigint").alias("template_length"),
        (F.col("l_partkey") % 7 - 3).alias("tag_as"),
    )


_ALIGN_SQL = """SELECT l_orderkey || '_' || l_linenumber AS read_id, 'g' || (l_suppkey % 10) AS reference, l_partkey + 1 AS position,
  l_partkey + 1 + l_quantity::BIGINT + 8 AS stop_position, l_quantity::INT || 'M3D2I5M' AS cigar, l_partkey % 7 - 3 AS tag_as FROM lineitem"""


def _lengths(spark) -> DataFrame:
    return spark.range(10).select(F.concat(F.lit("g"), F.col("id").cast("string")).alias("name"), F.lit(100000000).cast("bigint").alias("length"))


@query("s2_k3_sam_round_trip", _ALIGN_SQL)
def _sam(spark, sf):
    path = scratch_path(spark, "x.sam")
    sinks.write_sam(_alignments(spark, sf), path, reference_lengths_table=_lengths(spark))
    return sam.read_sam(spark, path).select("read_id", "reference", "position", "stop_position", "cigar", "tag_as")


@query("s2_k4_bam_round_trip", _ALIGN_SQL)
def _bam(spark, sf):
    path = scratch_path(spark, "x.bam")
    sinks.write_bam(_alignments(spark, sf), path, _lengths(spark))
    return sam.read_alignments(spark, path).select("read_id", "reference", "position", "stop_position", "cigar", "tag_as")


@query("s4_sequences_of_sam", _DNA_SQL + "SELECT 'r' || doc_id AS read_id, upper(s) AS sequence1 FROM dna WHERE length(s) > 0")
def _sequences_sam(spark, sf):
    rows = _records(spark, sf)
    line = F.concat_ws("\t", "read_id", F.lit("4\t*\t0\t0\t*\t*\t0\t0"), "sequence1", F.lit("*"))
    path = scratch_path(spark, "x.sam")
    sinks._write(path, rows.select(F.concat(line, F.lit("\n")).alias("value")), False)
    return sam.read_sequences_sam(spark, path).select("read_id", "sequence1")


@query("s6_k5_biom_round_trip", "SELECT o_custkey::VARCHAR AS sample_id, o_orderpriority AS feature_id, round(sum(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2 HAVING sum(o_totalprice) > 1e-10")
def _biom(spark, sf):
    cells = _t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("sample_id"), F.col("o_orderpriority").alias("feature_id"), F.col("o_totalprice").alias("value"))
    path = scratch_path(spark, "x.biom")
    sinks.write_biom(cells, path)
    return biom.read_biom(spark, path).select("sample_id", "feature_id", F.round("value", 4).alias("value"))


@query("k5_feature_cells", "SELECT o_custkey::VARCHAR AS sample_id, o_orderpriority AS feature_id, round(sum(o_totalprice - 100000), 4) AS value FROM orders GROUP BY 1, 2 HAVING sum(o_totalprice - 100000) > 1e-10")
def _cells(spark, sf):
    cells = _t(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("sample_id"), F.col("o_orderpriority").alias("feature_id"), (F.col("o_totalprice") - 100000).alias("value"))
    return sinks.feature_cells(cells).select("sample_id", "feature_id", F.round("value", 4).alias("value"))


@query("s7_k6_newick_round_trip", f"SELECT t.name, t.branch_length, p.name AS parent, t.node_index >= 1000 OR NOT EXISTS (FROM ({_TREE_SQL}) c WHERE c.parent_index = t.node_index) AS is_tip FROM ({_TREE_SQL}) t LEFT JOIN ({_TREE_SQL}) p ON t.parent_index = p.node_index")
def _newick(spark, sf):
    path = scratch_path(spark, "x.nwk")
    sinks.write_newick(_geography(spark, sf), path)
    t = newick.read_newick(spark, path)
    p = t.select(F.col("node_index").alias("parent_index"), F.col("name").alias("parent"))
    return t.join(p, "parent_index", "left").select("name", "branch_length", "parent", "is_tip")


@query("s8_read_gff", "SELECT 'chr' || (o_custkey % 20) AS seqid, o_orderstatus AS type, o_orderkey::INT AS position, (o_orderkey + 10)::INT AS stop_position, CASE WHEN o_orderkey % 3 > 0 THEN (o_orderkey % 3)::DOUBLE END AS score, 'x' || o_orderkey AS id FROM orders")
def _gff(spark, sf):
    o = _t(spark, sf, "orders")
    k = F.col("o_orderkey")
    line = F.concat_ws("\t", F.concat(F.lit("chr"), (F.col("o_custkey") % 20).cast("string")), F.lit("src"), "o_orderstatus", k.cast("string"), (k + 10).cast("string"), F.when(k % 3 > 0, (k % 3).cast("string")).otherwise("."), F.lit("+"), F.lit("."), F.concat(F.lit("ID=x"), k.cast("string")))
    path = scratch_path(spark, "x.gff")
    sinks._write(path, o.select(F.concat(line, F.lit("\n")).alias("value")), False, b"##gff-version 3\n")
    return text.read_gff(spark, path).select("seqid", "type", "position", "stop_position", "score", F.col("attributes")["ID"].alias("id"))


@query("s9_read_jplace", "SELECT 'f' || s_suppkey AS fragment, (s_suppkey % 7)::INT AS edge_num, 0.5::DOUBLE AS like_weight_ratio, (s_suppkey * 0.25)::DOUBLE AS pendant_length FROM supplier")
def _jplace(spark, sf):
    k = F.col("s_suppkey")
    item = F.concat(F.lit('{"p":[['), F.concat_ws(",", (k % 7).cast("string"), F.lit("-1.5"), F.lit("0.5"), F.lit("0.1"), (k * 0.25).cast("string")), F.lit(']],"nm":[["f'), k.cast("string"), F.lit('",1]]}'))
    one = _t(spark, sf, "supplier").agg(F.concat(F.lit('{"placements":['), F.array_join(F.collect_list(item), ","), F.lit("]}")).alias("value"))
    path = scratch_path(spark, "x.jplace")
    sinks._write(path, one, False)
    return text.read_jplace(spark, path).select("fragment", "edge_num", "like_weight_ratio", "pendant_length")


@query("s5_read_sff", "SELECT 'r' || r_regionkey AS read_id, 'ACGT' AS sequence1 FROM region")
def _sff(spark, sf):
    from lichenmill.sources.sff_builder import build_sff

    names = [f"r{r[0]}" for r in _t(spark, sf, "region").select("r_regionkey").orderBy("r_regionkey").collect()]  # five regions
    path = scratch_path(spark, "x.sff")
    with open(path, "wb") as f:
        f.write(build_sff([(n, "TTACGTA", [30] * 7, 3, 6) for n in names]))
    return sff.read_sequences_sff(spark, path).select("read_id", "sequence1")


@query("k7_best_placements", """SELECT fragment_id, edge_id, ratio, pendant FROM (
  SELECT o_custkey::VARCHAR AS fragment_id, o_orderkey AS edge_id, round(o_totalprice, 2) AS ratio, o_orderkey % 13 / 4.0 AS pendant,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey % 13, o_orderkey) AS no FROM orders) WHERE no = 1""")
def _placements(spark, sf):
    rows = _t(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("fragment_id"), F.col("o_orderkey").alias("edge_id"), F.col("o_totalprice").alias("like_weight_ratio"), ((F.col("o_orderkey") % 13) / 4.0).alias("pendant_length")
    )
    return tree.best_placements_frame(rows).select("fragment_id", "edge_id", F.round("like_weight_ratio", 2).alias("ratio"), F.col("pendant_length").alias("pendant"))


_INSERT_SQL = f"""
WITH t AS ({_TREE_SQL}),
p AS (SELECT 'f' || s_suppkey AS fragment, s_nationkey + 100 AS edge, (s_suppkey % 4) / 2.0 AS distal, s_suppkey FROM supplier)
SELECT name, branch_length, is_tip FROM (
  SELECT t.name, CASE WHEN t.node_index BETWEEN 100 AND 999 THEN coalesce((SELECT min(distal) FROM p WHERE edge = t.node_index), t.branch_length) ELSE t.branch_length END AS branch_length,
    t.node_index >= 1000 OR NOT EXISTS (FROM t c WHERE c.parent_index = t.node_index) AS is_tip FROM t
  UNION ALL SELECT fragment, 0.1, true FROM p
  UNION ALL SELECT NULL, coalesce(lag(distal) OVER (PARTITION BY edge ORDER BY distal DESC), 2.0) - distal, false FROM p)
"""


@query("k7_insert_placements", _INSERT_SQL)
def _insert(spark, sf):
    t = _geography(spark, sf).withColumn("edge_id", F.col("node_index"))
    p = _t(spark, sf, "supplier").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("fragment_id"), (F.col("s_nationkey") + 100).cast("bigint").alias("edge_id"), F.lit(1.0).alias("like_weight_ratio"), (F.col("s_suppkey") % 4 / 2).alias("distal_length"), F.lit(0.1).alias("pendant_length"))
    path = scratch_path(spark, "x.nwk")
    sinks.write_newick(t, path, placements=p)
    return newick.read_newick(spark, path).select(F.when(F.col("name") != "", F.col("name")).alias("name"), "branch_length", "is_tip")


# --- T1 to T8 ------------------------------------------------------------------------------------


_LONG = 400
_READ_SQL = f"FROM dna WHERE length(s) > {_LONG}"


def _references(spark, sf) -> DataFrame:
    """The nucleotides of every whole text that has enough of them."""
    rows = _dna(spark, sf).select(F.concat(F.lit("ref"), F.col("doc_id").cast("string")).alias("read_id"), F.upper("s").alias("sequence1"))
    return rows.where(F.length("sequence1") > _LONG)


def _written(spark, rows: DataFrame, name: str) -> DataFrame:
    """Rows that are dear to make and read many times."""
    path = scratch_table(spark, name)
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _fragments(references: DataFrame) -> DataFrame:
    """A read of 150 bases of each reference."""
    return _spread(references.select(F.concat(F.lit("q"), F.col("read_id")).alias("read_id"), F.substring("sequence1", 101, 150).alias("sequence1")))


def _best_alignments(references: DataFrame, found: DataFrame) -> DataFrame:
    """Every read's primary alignment, and whether the reference has the read where it says."""
    first = found.where(F.col("flags").bitwiseAND(F.lit(0x900)) == 0)
    subjects = references.select(F.col("read_id").alias("reference"), F.col("sequence1").alias("subject"))
    reads = _fragments(references).select("read_id", F.col("sequence1").alias("query"))
    rows = first.join(subjects, "reference").join(reads, "read_id")
    there = F.substring("subject", F.col("position").cast("int"), (F.col("stop_position") - F.col("position") + 1).cast("int"))
    turned = F.when(F.col("flags").bitwiseAND(F.lit(0x10)) > 0, sequences.sequence_dna_reverse_complement("query")).otherwise(F.col("query"))
    return rows.select("read_id", "cigar", "tag_as", "tag_nm", (there == turned).alias("is_there"))


_BEST_SQL = _DNA_SQL + f"SELECT 'qref' || doc_id AS read_id, '150=' AS cigar, 300::BIGINT AS tag_as, 0::BIGINT AS tag_nm, true AS is_there {_READ_SQL}"


@query("t1_align_minimap2", _BEST_SQL)
def _minimap2(spark, sf):
    references = _written(spark, _references(spark, sf), "references")
    return _best_alignments(references, align.align_minimap2(spark, _fragments(references), references))


@query("t2_save_index", _DNA_SQL + f"SELECT true AS success, count(*) AS num_subjects, count(*) AS num_read, sum(length(s))::BIGINT AS bases {_READ_SQL}")
def _save_index(spark, sf):
    path = scratch_path(spark, "x.mmi")
    done = align.save_minimap2_index(spark, _references(spark, sf), path).select("success", "num_subjects")
    subjects = align.open_index(spark, path)[0]
    return done.crossJoin(subjects.agg(F.count("*").alias("num_read"), F.sum(F.length("sequence")).alias("bases")))


@query("t3_align_sharded", _BEST_SQL)
def _sharded(spark, sf):
    folder = scratch_path(spark, "shards")
    references = _written(spark, _references(spark, sf), "references")
    shard = lambda: F.pmod(F.xxhash64(F.regexp_extract("read_id", "ref.*", 0)), F.lit(4)).cast("string")
    for k in "0123":
        align.save_minimap2_index(spark, references.where(shard() == k), f"{folder}/{k}.mmi")
    q = _fragments(references)
    return _best_alignments(references, align.align_minimap2_sharded(spark, q, folder, q.select("read_id", shard().alias("shard_name"))))


@query(
    "t4_bowtie2_arguments",
    """SELECT * FROM (VALUES (0, 'bowtie2'), (1, '-x'), (2, 'index'), (3, '-q'), (4, '--interleaved'), (5, '-'), (6, '-p'), (7, '1'),
       (8, '--sensitive-local'), (9, '-k'), (10, '3'), (11, '--quiet')) t(no, argument)""",
)
def _bowtie2_args(spark, sf):
    args = align.bowtie2_arguments("index", True, False, "sensitive", True, 1, 2, None, True)
    return spark.createDataFrame([(i, a) for i, a in enumerate(args)], "no int, argument string")


def _bases(spark, sf) -> DataFrame:
    return _spread(_dna(spark, sf).select(F.col("doc_id").cast("string").alias("read_id"), F.upper("s").alias("sequence1")))


# Hashes of all 16-mers of sequences x (id, s), by prefix sums of their purine bits, and the least of each 8.
_MINIMIZER_SQL = """
bits AS (SELECT id, translate(s, 'ACGT', '1010') AS b, length(s) - 15 AS n FROM {x} WHERE length(s) >= 16),
km AS (SELECT id, i, n, xor(substr(b, i::INT, 16)::BIT::BIGINT, 6148914691236517205::BIGINT) AS h FROM (SELECT id, b, n, unnest(range(1, n + 1)) AS i FROM bits)),
w AS (SELECT id, i, n, min(h) OVER f AS m, arg_min(i, h) OVER f AS place FROM km WINDOW f AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
picked AS (SELECT id, m, place FROM w WHERE i <= greatest(n - 7, 1))
"""
_STRANDS_SQL = _DNA_SQL + """, strands AS (
  SELECT doc_id::VARCHAR || '+' AS id, upper(s) AS s FROM dna UNION ALL SELECT doc_id::VARCHAR || '-', translate(reverse(upper(s)), 'ACGT', 'TGCA') FROM dna),
"""


@query(
    "t7_minimizer_set",
    _STRANDS_SQL + _MINIMIZER_SQL.format(x="strands") + " SELECT DISTINCT substr(id, 1, length(id) - 1) AS read_id, substr(id, -1) AS strand, m AS minimizer FROM picked",
)
def _minimizer_set(spark, sf):
    rows = minimizers.extract_minimizer_set(spark, _bases(spark, sf), 16, 8)
    each = lambda c, strand: rows.select("read_id", F.lit(strand).alias("strand"), F.explode(F.transform(c, lambda h: h.cast("bigint"))).alias("minimizer"))
    return each("fwd_set", "+").unionByName(each("rc_set", "-"))


@query(
    "t8_strand_minimizers",
    _STRANDS_SQL + _MINIMIZER_SQL.format(x="strands") + """
, sums AS (SELECT id, count(*) AS n, sum(place - 1)::BIGINT AS places, sum(m % 1000003)::BIGINT AS hashes FROM (SELECT DISTINCT id, m, place FROM picked) GROUP BY id)
SELECT d.doc_id::VARCHAR AS read_id, coalesce(f.n, 0)::INT AS n_fwd, coalesce(r.n, 0)::INT AS n_rc, coalesce(f.places, 0) AS fwd_places, coalesce(r.places, 0) AS rc_places,
  coalesce(f.hashes, 0) AS fwd_hashes, coalesce(r.hashes, 0) AS rc_hashes
FROM dna d LEFT JOIN sums f ON f.id = d.doc_id || '+' LEFT JOIN sums r ON r.id = d.doc_id || '-'""",
)
def _strand(spark, sf):
    rows = minimizers.extract_strand_minimizers(spark, _bases(spark, sf), 16, 8)
    total = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    hashes = lambda c: F.transform(c, lambda h: h.cast("bigint") % 1000003)
    return rows.select(
        "read_id",
        F.size("fwd_hashes").alias("n_fwd"),
        F.size("rc_positions").alias("n_rc"),
        total("fwd_positions").alias("fwd_places"),
        total("rc_positions").alias("rc_places"),
        total(hashes("fwd_hashes")).alias("fwd_hashes"),
        total(hashes("rc_hashes")).alias("rc_hashes"),
    )


@query(
    "t6_classify",
    _DNA_SQL + """, strands AS (
  SELECT doc_id || '+' AS id, upper(s) AS s FROM dna WHERE length(s) > 400
  UNION ALL SELECT doc_id || 'f', substr(upper(s), 101, 150) FROM dna WHERE length(s) > 400
  UNION ALL SELECT doc_id || 'r', translate(reverse(substr(upper(s), 101, 150)), 'ACGT', 'TGCA') FROM dna WHERE length(s) > 400),
"""
    + _MINIMIZER_SQL.format(x="strands")
    + """, sets AS (SELECT DISTINCT substr(id, 1, length(id) - 1) AS d, substr(id, -1) AS side, m FROM picked),
sizes AS (SELECT d, side, count(*) AS n FROM sets WHERE side <> '+' GROUP BY ALL),
hits AS (SELECT q.d, q.side, x.d AS bucket, count(*) AS hits FROM sets q JOIN sets x ON q.m = x.m AND q.side <> '+' AND x.side = '+' GROUP BY ALL),
scores AS (SELECT d, bucket, max(hits / n) AS score FROM hits JOIN sizes USING (d, side) GROUP BY ALL)
SELECT 'qref' || d AS read_id, 'ref' || bucket AS bucket_name, round(score, 6) AS score FROM scores WHERE score >= 0.5""",
)
def _classify(spark, sf):
    path = scratch_path(spark, "x.index")
    minimizers.build_index(spark, _references(spark, sf), path, k=16, w=8)
    return minimizers.classify(spark, path, _fragments(_references(spark, sf)), threshold=0.5).select("read_id", "bucket_name", F.round("score", 6).alias("score"))


# --- relational operators ------------------------------------------------------------------------


def _sql_query(name: str, sql: str, own: str | None = None) -> None:
    """A query that is the same text for both engines unless ``own`` has Spark's form."""

    def run(spark, sf):
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark"):
            if t in sql:
                _t(spark, sf, t).createOrReplaceTempView(t)
        return spark.sql(own or sql)

    query(name, sql)(run)


_sql_query("r_filter_project", "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.05 THEN 'high' ELSE 'low' END AS kind FROM lineitem WHERE l_quantity BETWEEN 10 AND 20 AND l_returnflag IN ('A', 'R') AND l_linestatus LIKE 'F%'")
_sql_query("r_join_inner", "SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
_sql_query("r_join_left", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
_sql_query("r_join_semi", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000)")
_sql_query("r_join_anti", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
_sql_query("r_join_theta", "SELECT n_name, r_name FROM nation JOIN region ON length(n_name) > length(r_name) + 3")
_sql_query("r_range_overlap", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey <= 2000 AND l_orderkey + l_quantity >= 1000")
_sql_query("r_aggregate_having", "SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_suppkey HAVING count(*) > 5")
_sql_query("r_filtered_aggregate", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS n FROM lineitem GROUP BY l_returnflag")
_sql_query("r_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
_sql_query("r_window", "SELECT o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS following, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS no FROM orders")
_sql_query("r_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql_query("r_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql_query("r_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
_sql_query("r_limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 40")
_sql_query("r_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_sql_query("r_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier")
_sql_query("r_intersect", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_sql_query("r_unnest", "SELECT n_name, unnest(string_split(n_name, 'A')) AS part FROM nation", "SELECT n_name, explode(split(n_name, 'A')) AS part FROM nation")
_sql_query("r_scalar_subquery", "SELECT r_name, (SELECT count(*) FROM nation WHERE n_regionkey = r_regionkey) AS n FROM region")
_sql_query("r_recursive_cte", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < (SELECT count(*) FROM region)) SELECT n FROM t")
_sql_query(
    "r_list_builtins",
    "SELECT o_orderkey, list_sum(list_transform([o_orderkey % 7, o_custkey % 5, 3], lambda x: x * 2))::BIGINT AS total, list_contains([o_orderkey % 7, 3], 3) AS has, len(list_filter([o_orderkey % 7, o_custkey % 5], lambda x: x > 2))::INT AS big, list_sort([o_orderkey % 7, o_custkey % 5])[1]::BIGINT AS least, array_to_string(list_distinct(['a', 'a']), '-') AS once FROM orders",
    "SELECT o_orderkey, CAST(aggregate(transform(array(o_orderkey % 7, o_custkey % 5, 3), x -> x * 2), 0L, (a, x) -> a + x) AS BIGINT) AS total, array_contains(array(o_orderkey % 7, 3), 3) AS has, size(filter(array(o_orderkey % 7, o_custkey % 5), x -> x > 2)) AS big, CAST(array_sort(array(o_orderkey % 7, o_custkey % 5))[0] AS BIGINT) AS least, array_join(array_distinct(array('a', 'a')), '-') AS once FROM orders",
)
_sql_query(
    "r_json_and_dates",
    """SELECT o_orderkey, json_extract_string('{"k": ' || o_orderkey || ', "s": "' || o_orderstatus || '"}', '$.s') AS s, json_extract_string('{"k": ' || o_orderkey || '}', '$.k')::BIGINT AS k, try_cast('19' || (o_orderkey % 90 + 10) || '-02-29' AS DATE) AS leap FROM orders""",
    """SELECT o_orderkey, get_json_object('{"k": ' || o_orderkey || ', "s": "' || o_orderstatus || '"}', '$.s') AS s, CAST(get_json_object('{"k": ' || o_orderkey || '}', '$.k') AS BIGINT) AS k, try_to_date('19' || (o_orderkey % 90 + 10) || '-02-29', 'yyyy-MM-dd') AS leap FROM orders""",
)
_sql_query("r_self_join_map", "SELECT a.p_partkey, count(*) AS n FROM (SELECT p_partkey, MAP {'brand': p_brand, 'size': p_size::VARCHAR} AS m FROM part) a JOIN (SELECT MAP {'brand': p_brand, 'size': p_size::VARCHAR} AS m FROM part) b ON a.m['brand'] = b.m['brand'] AND a.m['size'] = b.m['size'] GROUP BY a.p_partkey", "SELECT a.p_partkey, count(*) AS n FROM (SELECT p_partkey, map('brand', p_brand, 'size', CAST(p_size AS STRING)) AS m FROM part) a JOIN (SELECT map('brand', p_brand, 'size', CAST(p_size AS STRING)) AS m FROM part) b ON a.m['brand'] = b.m['brand'] AND a.m['size'] = b.m['size'] GROUP BY a.p_partkey")
_sql_query("r_scalar_builtins", "SELECT n_name, round(abs(n_nationkey - 10.5), 2)::DOUBLE AS x, length(n_name)::BIGINT AS n, regexp_extract(n_name, '^[A-M]+', 0) AS head FROM nation", "SELECT n_name, CAST(round(abs(n_nationkey - 10.5), 2) AS DOUBLE) AS x, CAST(length(n_name) AS BIGINT) AS n, regexp_extract(n_name, '^[A-M]+', 0) AS head FROM nation")
