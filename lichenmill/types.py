"""Relation schemas (as DDL) and input-relation checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Column names and types of the relations.
SEQUENCE = "sequence_index bigint, read_id string, comment string, sequence1 string, sequence2 string, qual1 array<smallint>, qual2 array<smallint>"
ALIGNMENT = (
    "read_id string, flags int, reference string, position bigint, stop_position bigint, mapq smallint, cigar string, "
    "mate_reference string, mate_position bigint, template_length bigint, tag_as bigint, tag_xs bigint, tag_ys bigint, "
    "tag_xn bigint, tag_xm bigint, tag_xo bigint, tag_xg bigint, tag_nm bigint, tag_yt string, tag_md string, tag_sa string"
)
SEQ_QUAL = "sequence string, qual array<smallint>"
FEATURE_TABLE = "sample_id string, feature_id string, value double"
TREE = "node_index bigint, name string, branch_length double, edge_id bigint, parent_index bigint, is_tip boolean"
ANNOTATION = "seqid string, source string, type string, position int, stop_position int, score double, strand string, phase int, attributes map<string,string>"
PLACEMENT = "fragment string, edge_num int, likelihood double, like_weight_ratio double, distal_length double, pendant_length double, filepath string"
ACCESSION = "accession string, version int, description string, organism string, taxonomy_id bigint, length bigint, molecule_type string, update_date date"
CLASSIFICATION = "read_id string, bucket_id bigint, bucket_name string, score double"
MINIMIZER_SET = "read_id string, fwd_set array<decimal(20,0)>, rc_set array<decimal(20,0)>"
STRAND_MINIMIZERS = "read_id string, fwd_hashes array<decimal(20,0)>, fwd_positions array<bigint>, rc_hashes array<decimal(20,0)>, rc_positions array<bigint>"
INDEX_REPORT = "success boolean, index_path string, num_subjects bigint"


def as_frame(spark, relation) -> DataFrame:
    """A DataFrame from a DataFrame or the name of a table or view."""
    if isinstance(relation, DataFrame):
        return relation
    if not spark.catalog.tableExists(relation):
        raise ValueError(f"Table or view '{relation}' does not exist")
    return spark.table(relation)


def check_sequence_table(df: DataFrame, what: str, id_column: str = "read_id", subject: bool = False) -> DataFrame:
    """Check a sequence relation; names match in any case."""
    named = {c.lower(): c for c in df.columns}
    for c in (id_column, "sequence1"):
        if c.lower() not in named:
            raise ValueError(f"{what}: missing required column '{c}'")
    if not isinstance(df.schema[named["sequence1"]].dataType, T.StringType):
        raise ValueError(f"{what}: column 'sequence1' must be VARCHAR")
    if subject and "sequence2" in named:
        raise ValueError(f"{what}: subject tables cannot have a 'sequence2' column")
    for c in ("qual1", "qual2"):
        if c in named and not isinstance(df.schema[named[c]].dataType, T.ArrayType):
            raise ValueError(f"{what}: column '{c}' must be a list")
    return df


def check_read_to_shard(df: DataFrame, what: str) -> DataFrame:
    """Check a read-to-shard relation: both columns, at least one row, no null shard."""
    named = {c.lower() for c in df.columns}
    for c in ("read_id", "shard_name"):
        if c not in named:
            raise ValueError(f"{what}: read_to_shard is missing required column '{c}'")
    if df.isEmpty():
        raise ValueError(f"{what}: read_to_shard is empty")
    if not df.where("shard_name is null").isEmpty():
        raise ValueError(f"{what}: read_to_shard has a NULL shard_name")
    return df
