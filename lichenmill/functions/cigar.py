"""CIGAR and MD arithmetic.

A CIGAR is read once, by one Arrow pass over a batch of texts, into the totals of its operations;
everything else is column arithmetic on these. Calls on the same column share that pass.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the operations, in the order of their BAM codes.
OPS = "MIDNSHP=X"
_OP = re.compile(rf"(\d+)([{OPS}])")
_MOST = 9223372036854775807
_CODE = np.full(256, -1, np.int8)
_CODE[np.frombuffer(OPS.encode(), np.uint8)] = np.arange(len(OPS))
_FIELDS = [*(f"op{i}" for i in range(len(OPS))), "opens"]


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _opt(x) -> Column:
    """A literal, unless a column is given."""
    return x if isinstance(x, Column) else F.lit(x)


def cigar_problem(text: str) -> str | None:
    """What is wrong with a CIGAR; None if nothing is."""
    lengths = [int(n) for n, _ in _OP.findall(text)]
    if max(lengths, default=0) > _MOST or re.search(r"\d{20,}", text):
        return "CIGAR operation length exceeds maximum"
    rest = text[re.match(rf"(?:{_OP.pattern})*", text).end() :]
    first = rest.lstrip("0123456789")[:1]
    if rest and not first:
        return "Invalid CIGAR string: incomplete operation (missing operation character)"
    if rest and not rest[0].isdigit() and first in OPS:
        return "Invalid CIGAR string: operation without length"
    if rest:
        return f"Invalid CIGAR operation: {first}"
    return "Invalid CIGAR string: operation with zero length" if 0 in lengths else None


def _one(text: str) -> tuple[list[int], str | None]:
    """(totals by operation and gap openings, problem) of one text."""
    found = _OP.findall(text)
    totals = [0] * len(_FIELDS)
    for i, (n, op) in enumerate(found):
        totals[OPS.index(op)] += int(n)
        totals[-1] += op in "ID" and (i == 0 or found[i - 1][1] != op)
    problem = None if text in ("", "*") else cigar_problem(text)
    if problem is None and max(totals) > _MOST:
        raise OverflowError("CIGAR totals exceed 64 bits")
    return [0] * len(totals) if problem else totals, problem


def cigar_totals(column: pa.Array) -> tuple[np.ndarray, dict[int, str]]:
    """(a row of totals by operation and of gap openings for each text, problems by row); null counts as ''.

    Gap openings are maximal runs of one and the same gap operation. Well-formed texts are read as one
    byte array; one that is not, or that has a length of over 15 digits or of 0, is looked at alone.
    """
    texts = column.cast(pa.string()).fill_null("")
    n = len(texts)
    out = np.zeros((n, len(_FIELDS)), np.int64)
    at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    sizes = np.diff(at)
    flat = np.frombuffer(texts.buffers()[2], np.uint8)[at[0] : at[-1]] if sizes.any() else np.empty(0, np.uint8)
    if not len(flat):
        return out, {}
    row = np.repeat(np.arange(n), sizes)
    digit, code = (flat >= 48) & (flat <= 57), _CODE[flat]
    op = np.flatnonzero(code >= 0)
    odd = np.zeros(n, bool)
    odd[row[~digit & (code < 0)]] = True
    end = np.cumsum(sizes)[sizes > 0] - 1
    odd[row[end[digit[end]]]] = True  # the last character is no operation
    if len(op):
        start = np.concatenate([[0], op[:-1] + 1])
        first = np.concatenate([[True], row[op[1:]] != row[op[:-1]]])
        start = np.where(first, (np.cumsum(sizes) - sizes)[row[op]], start)
        odd[row[op[(op - start < 1) | (op - start > 15)]]] = True
    else:
        odd |= sizes > 0
    good = ~odd[row[op]]
    if good.any():
        op, start, first = op[good], start[good], first[good]
        used = digit & ~odd[row]
        at = np.flatnonzero(used)
        power = op[np.searchsorted(op, at)] - 1 - at
        value = np.add.reduceat((flat[at].astype(np.int64) - 48) * 10**power, np.searchsorted(at, start))
        kind, of = code[op].astype(np.int64), row[op]
        np.add.at(out, (of, kind), value)
        gap = (kind == 1) | (kind == 2)
        fresh = first | np.concatenate([[True], kind[1:] != kind[:-1]])
        np.add.at(out, (of[gap & fresh], np.full(int((gap & fresh).sum()), len(_FIELDS) - 1)), 1)
        odd[of[value == 0]] = True
    problems = {}
    for i in np.flatnonzero(odd).tolist():
        out[i], problem = _one(texts[i].as_py())
        if problem:
            problems[i] = problem
    return out, problems


@F.arrow_udf(T.StructType([*(T.StructField(f, T.LongType()) for f in _FIELDS), T.StructField("problem", T.StringType())]))
def _parse(text: pa.Array) -> pa.Array:
    totals, problems = cigar_totals(text)
    said = pa.array([problems.get(i) for i in range(len(text))] if problems else [None] * len(text), pa.string())
    return pa.StructArray.from_arrays([*(pa.array(totals[:, i]) for i in range(len(_FIELDS))), said], [*_FIELDS, "problem"])


class Cigar:
    """Expressions over one CIGAR column."""

    def __init__(self, cigar: Column):
        self.text = cigar
        self.parts = _parse(cigar.cast("string"))

    def blank(self) -> Column:
        return (self.text == "") | (self.text == "*")

    def problem(self) -> Column:
        """What is wrong with the CIGAR; NULL if nothing is, or if it is NULL."""
        return self.parts["problem"]

    def total(self, ops: str) -> Column:
        whole = self.parts[f"op{OPS.index(ops[0])}"]
        for o in ops[1:]:
            whole = whole + self.parts[f"op{OPS.index(o)}"]
        return F.when(self.text.isNotNull(), whole)

    def gap_opens(self) -> Column:
        """Maximal runs of one and the same gap operation."""
        return F.when(self.text.isNotNull(), self.parts["opens"])


def _kinds(more: tuple[pa.Array, ...], n: int, default) -> list:
    """The value for each row of an argument that may be left out."""
    return more[0].to_pylist() if more else [default] * n


def _fail(problems: dict[int, str], texts: list, wanted: np.ndarray) -> None:
    for i, said in problems.items():
        if wanted[i] and texts[i] not in (None, "", "*"):
            raise ValueError(said)


def _sum(totals: np.ndarray, ops: str) -> np.ndarray:
    return totals[:, [OPS.index(o) for o in ops]].sum(axis=1)


def _known(column: pa.Array) -> np.ndarray:
    return ~np.asarray(column.is_null())


def query_length(cigar: pa.Array, *include_hard_clips: pa.Array) -> pa.Array:
    totals, problems = cigar_totals(cigar)
    hard = _kinds(include_hard_clips, len(cigar), True)
    known = _known(cigar) & np.array([h is not None for h in hard], bool)
    _fail(problems, cigar.to_pylist() if problems else [], known)
    value = _sum(totals, "M=XIS") + np.where(np.array([bool(h) for h in hard], bool), _sum(totals, "H"), 0)
    return pa.array(value, mask=~known)


def query_coverage(cigar: pa.Array, *type: pa.Array) -> pa.Array:
    totals, problems = cigar_totals(cigar)
    texts, kinds = cigar.to_pylist(), _kinds(type, len(cigar), "aligned")
    known = _known(cigar) & np.array([k is not None for k in kinds], bool)
    _fail(problems, texts, known)
    query = _sum(totals, "M=XISH")
    covered = np.zeros(len(cigar), np.int64)
    for kind in set(kinds) - {None}:
        at = np.array([k == kind for k in kinds], bool)
        if kind not in ("aligned", "mapped"):
            if (at & known & (query > 0)).any():
                raise ValueError(f"Invalid coverage type: {kind}")
            continue
        covered[at] = _sum(totals, "M=X" if kind == "aligned" else "M=XI")[at]
    return pa.array(np.where(query > 0, covered / np.maximum(query, 1), 0.0), mask=~known)


_MD_GAPS, _MD_NUMBERS = re.compile(r"\^[A-Za-z]*"), re.compile(r"\d+")


def md_pair(md: str) -> tuple[int, int]:
    """(matches, mismatches) of an MD string: deletions are skipped, other characters do not end a number."""
    clean = re.sub(r"[^0-9A-Za-z ]", "", _MD_GAPS.sub(" ", md))
    return sum(map(int, _MD_NUMBERS.findall(clean))), sum(c.isalpha() for c in clean)


def seq_identity(cigar: pa.Array, nm: pa.Array, md: pa.Array, *type: pa.Array) -> pa.Array:
    n = len(cigar)
    totals, problems = cigar_totals(cigar)
    texts, kinds = cigar.to_pylist(), np.array(_kinds(type, n, "gap_compressed"), object)
    usable = np.array([t not in (None, "", "*") for t in texts], bool)
    usable[list(problems)] = False
    edits = nm.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
    aligned, gaps = _sum(totals, "M=X"), _sum(totals, "ID")
    above, below = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for kind in set(kinds[usable].tolist()) - {None}:
        at = usable & (kinds == kind)
        counted = at & (edits >= 0) & (edits <= aligned + gaps)
        if kind == "gap_excluded":
            for i in np.flatnonzero(at).tolist():
                if (text := md[i].as_py()) not in (None, ""):
                    above[i], other = md_pair(text)
                    below[i] = above[i] + other
        elif kind == "blast":
            above[counted], below[counted] = (aligned + gaps - edits)[counted], (aligned + gaps)[counted]
        elif kind == "gap_compressed":
            above[counted], below[counted] = (aligned - edits + gaps)[counted], (aligned + totals[:, -1])[counted]
        else:
            raise ValueError(f"Invalid type parameter for alignment_seq_identity: {kind}")
    return pa.array(above / np.maximum(below, 1), mask=below <= 0)


#: The kernels by SQL name, for DataFrame and SQL alike; trailing arguments may be left out.
KERNELS = {
    "alignment_seq_identity": F.arrow_udf(seq_identity, T.DoubleType()),
    "alignment_query_length": F.arrow_udf(query_length, T.LongType()),
    "alignment_query_coverage": F.arrow_udf(query_coverage, T.DoubleType()),
}


def alignment_query_length(cigar: Column | str, include_hard_clips: Column | bool = True) -> Column:
    """Query length of a CIGAR; 0 for '' and '*', NULL for NULL, an error if it is invalid."""
    return KERNELS["alignment_query_length"](_c(cigar).cast("string"), _opt(include_hard_clips))


def alignment_query_coverage(cigar: Column | str, type: Column | str = "aligned") -> Column:
    """Covered share of the query, hard clips counted in its length: type 'aligned' (M, =, X) or 'mapped' (also I)."""
    return KERNELS["alignment_query_coverage"](_c(cigar).cast("string"), _opt(type))


def alignment_seq_identity(cigar: Column | str, nm: Column | str, md: Column | str, type: Column | str = "gap_compressed") -> Column:
    """Sequence identity: type 'gap_excluded' (from MD), 'blast' or 'gap_compressed' (from CIGAR and NM).

    NULL where the inputs that the type needs are NULL, absent or invalid; an unknown type is an error.
    """
    return KERNELS["alignment_seq_identity"](_c(cigar).cast("string"), _c(nm).cast("bigint"), _c(md).cast("string"), _opt(type))


def md_counts(md: Column) -> tuple[Column, Column]:
    """(matches, mismatches) of an MD string."""
    parts = _md_parts(md.cast("string"))
    return parts["matches"], parts["mismatches"]


@F.arrow_udf(T.StructType([T.StructField("matches", T.LongType()), T.StructField("mismatches", T.LongType())]))
def _md_parts(md: pa.Array) -> pa.Array:
    found = [(None, None) if t is None else md_pair(t) for t in md.to_pylist()]
    return pa.StructArray.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["matches", "mismatches"])


def cigar_stop(position: Column, cigar: Column) -> Column:
    """Half-open stop of an alignment that starts at ``position``."""
    return position + Cigar(cigar).total("M=XDN")
