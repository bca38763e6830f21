"""Feature counts of multi-mapped reads and genome coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lichenmill.functions.flags import alignment_is_read1

from .intervals import compress_intervals


def _weights(alignments: DataFrame, sequence_id: str, sample_id: str | None) -> DataFrame:
    """One row a (sample, read, mate, reference) with the share of the read that the reference gets."""
    cols = [F.col(sequence_id).alias("__read"), F.col("reference").alias("feature_id"), alignment_is_read1("flags").alias("__mate")]
    if sample_id:
        cols.append(F.col(sample_id).alias("sample_id"))
    one = alignments.select(*cols).distinct()
    # the share is over the read in all samples: a read id in two samples is split between them
    hits = F.count("*").over(Window.partitionBy("__read", "__mate"))
    return one.withColumn("__w", F.lit(1.0) / hits)


def woltka_ogu(alignments: DataFrame, sequence_id: str = "read_id") -> DataFrame:
    """feature_id, value: each read counts 1 in all, split evenly among its references."""
    return _weights(alignments, sequence_id, None).groupBy("feature_id").agg(F.sum("__w").alias("value"))


def woltka_ogu_per_sample(alignments: DataFrame, sample_id: str = "sample_id", sequence_id: str = "read_id") -> DataFrame:
    """sample_id, feature_id, value: the same by sample."""
    return _weights(alignments, sequence_id, sample_id).groupBy("sample_id", "feature_id").agg(F.sum("__w").alias("value"))


def genome_coverage(alignments: DataFrame, subject_total_length: DataFrame, subject_genome_id: DataFrame) -> DataFrame:
    """genome_id, covered, proportion_covered: bases under at least one alignment, of all contigs of a genome.

    ``alignments`` has reference, position, stop_position (half-open); ``subject_total_length`` genome_id,
    total_length; ``subject_genome_id`` contig_id, genome_id. Contigs without a genome and genomes without
    a length vanish. Joins are left to adaptive execution, which broadcasts a side of checked size.
    """
    merged = compress_intervals(alignments.select("reference", "position", "stop_position"), "reference", "position", "stop_position")
    per_contig = merged.groupBy("reference").agg(F.sum(F.col("stop_position") - F.col("position")).alias("covered"))
    genomes = per_contig.join(subject_genome_id, per_contig.reference == subject_genome_id.contig_id).groupBy("genome_id").agg(F.sum("covered").alias("covered"))
    return genomes.join(subject_total_length, "genome_id").select(
        "genome_id", "covered", F.try_divide(F.col("covered").cast("double"), F.col("total_length").cast("double")).alias("proportion_covered")
    )
