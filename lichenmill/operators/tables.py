"""Forms of the operators for SQL text: an aggregate over intervals and table functions.

A table function that takes a relation runs on the relation's partitions; one that takes a path reads
its files in one task (a view over the data source of the same files reads them in parallel).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lichenmill.operators import align, minimizers
from lichenmill.sources import biom, fastx, newick, sam, sff
from lichenmill.sources.base import expand_paths
from lichenmill.types import ALIGNMENT, FEATURE_TABLE, MINIMIZER_SET, SEQUENCE, TREE

_INTERVALS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def merged(start: np.ndarray, stop: np.ndarray) -> list[tuple[int, int]]:
    """Merged half-open intervals; touching ones are one."""
    lo, hi = np.minimum(start, stop), np.maximum(start, stop)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], np.maximum.accumulate(hi[order])
    if not len(lo):
        return []
    cut = np.flatnonzero(np.concatenate([[True], lo[1:] > hi[:-1]]))
    return list(zip(lo[cut].tolist(), hi[np.append(cut[1:], len(lo)) - 1].tolist()))


def _compress(start: pd.Series, stop: pd.Series):
    known = start.notna() & stop.notna()
    found = merged(start[known].to_numpy(np.int64), stop[known].to_numpy(np.int64))
    return [{"start": a, "stop": b} for a, b in found] or None


#: ``compress_intervals(start, stop)``: the group's merged intervals as a list, NULL without any. SQL's form
#: takes a group into one task; ``intervals.compress_intervals`` does not.
compress_intervals = F.pandas_udf(_compress, _INTERVALS, F.PandasUDFType.GROUPED_AGG)


def _scan(kind: str, source):
    """A table function over the files of a path or glob."""

    class Scan:
        def eval(self, path: str):
            for f in expand_paths(path, source.name()):
                yield from source.rows((f,))

    return F.udtf(Scan, returnType=kind)


class _MinimizerSet:
    def eval(self, row, k: int, w: int):
        minimizers.check_parameters(k, w)
        s = (row["sequence1"] or "").encode()
        sets = [np.unique(minimizers.minimizers(x, k, w)[0]) for x in (s, minimizers.reverse_complement(s))]
        yield (str(row["read_id"]), *(minimizers._decimals(x) for x in sets))


class _Align:
    def eval(self, row, index_path: str, max_secondary: int = 5):
        index = align.task_index(index_path)
        second = row["sequence2"] if "sequence2" in row else None
        if second is not None:
            found = align.align_pair(index, row["read_id"], row["sequence1"], second, max_secondary, True)
        else:
            found = align._single(row["read_id"], align.align_read(index, row["sequence1"], max_secondary))
        for r in found:
            yield tuple(r[c] for c in align._COLUMNS)


TABLE_FUNCTIONS = {
    "read_fastx": _scan(SEQUENCE, fastx.FastxSource),
    "read_alignments": _scan(ALIGNMENT, sam.AlignmentSource),
    "read_sam": _scan(ALIGNMENT, sam.AlignmentSource),
    "read_sequences_sam": _scan(SEQUENCE, sam.SamSequenceSource),
    "read_sequences_sff": _scan(SEQUENCE, sff.SffSource),
    "read_biom": _scan(FEATURE_TABLE, biom.BiomSource),
    "read_newick": _scan(TREE, newick.NewickSource),
    "extract_minimizer_set": F.udtf(_MinimizerSet, returnType=MINIMIZER_SET),
    "align_minimap2": F.udtf(_Align, returnType=ALIGNMENT),
}
