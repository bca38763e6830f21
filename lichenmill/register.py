"""SQL names of the scalar functions, the interval aggregate, the table functions and the file scans."""

from __future__ import annotations

from pyspark.sql import SparkSession

from lichenmill.functions import cigar, flags, misc, pairwise, sequences
from lichenmill.operators import tables
from lichenmill.sources import biom, fastx, newick, sam, sff, text


def _sequence_functions(spark: SparkSession) -> None:
    for alphabet, kind in ((sequences._DNA, "dna"), (sequences._RNA, "rna")):
        valid, to = alphabet.valid, "".join(alphabet.complement[c] for c in alphabet.valid)
        wrong = f"s RLIKE '{alphabet.outside.replace(chr(92), chr(92) * 2)}' THEN raise_error('Invalid {alphabet.name} base')"
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION sequence_{kind}_reverse_complement(s STRING) RETURNS STRING RETURN "
            f"CASE WHEN {wrong} ELSE translate(reverse(s), '{valid}', '{to}') END"
        )
        table = ", ".join(f"'{k}', '{v}'" for k, v in alphabet.expansion.items())
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION sequence_{kind}_as_regexp(s STRING) RETURNS STRING RETURN "
            f"CASE WHEN {wrong} ELSE array_join(transform(split(s, ''), c -> coalesce(try_element_at(map({table}), c), c)), '') END"
        )


def register(spark: SparkSession) -> None:
    """Define the engine's functions for SQL text.

    Flags, sequences and attributes are inlined expressions; CIGAR and pairwise functions are Arrow
    UDFs; ``compress_intervals(start, stop)`` is an aggregate; minimizers, read alignment against a saved
    index and the scans of files are table functions (``lichenmill.operators.tables``). File scans are
    data sources too, for ``CREATE TEMPORARY VIEW reads USING fastx OPTIONS (path '...')``.
    """
    for name, (mask, short) in flags.BITS.items():
        for n in (name, short):
            spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {n}(flags INT) RETURNS BOOLEAN RETURN (flags & {mask}) <> 0")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION alignment_is_primary(flags INT) RETURNS BOOLEAN RETURN (flags & 2304) = 0")
    _sequence_functions(spark)
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION parse_gff_attributes(s STRING) RETURNS MAP<STRING, STRING> RETURN "
        "map_from_entries(transform(split(s, ';'), x -> struct(get(split(x, '='), 0), get(split(x, '='), 1))))"
    )
    from lichenmill import __version__

    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION engine_version() RETURNS STRING RETURN '{__version__}'")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION bowtie2_available() RETURNS BOOLEAN RETURN {str(misc.bowtie2_available()).lower()}")
    for name, kernel in {**cigar.KERNELS, **pairwise.KERNELS, "compress_intervals": tables.compress_intervals}.items():
        spark.udf.register(name, kernel)
    for name, function in tables.TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
    for source in (fastx.FastxSource, sam.AlignmentSource, sam.SamSequenceSource, biom.BiomSource, newick.NewickSource, sff.SffSource):
        spark.dataSource.register(source)
