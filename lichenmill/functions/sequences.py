"""Nucleotide strings: reverse complements and IUPAC patterns as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# IUPAC nucleotide codes, their complements and the bases they stand for.
DNA_COMPLEMENT = {"A": "T", "C": "G", "G": "C", "T": "A", "R": "Y", "Y": "R", "S": "S", "W": "W", "K": "M", "M": "K", "B": "V", "D": "H", "H": "D", "V": "B", "N": "N"}
DNA_BASES = {"R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
GAPS = "-."


def _both_cases(table: dict[str, str]) -> dict[str, str]:
    return table | {k.lower(): v.lower() for k, v in table.items()}


def _rna(text: str) -> str:
    return text.replace("T", "U").replace("t", "u")


class _Alphabet:
    def __init__(self, name: str, rna: bool):
        to = _rna if rna else str
        self.name = name
        self.complement = {to(k): to(v) for k, v in _both_cases(DNA_COMPLEMENT).items()} | {g: g for g in GAPS}
        self.expansion = {k: f"[{to(v)}]" for k, v in _both_cases(DNA_BASES).items()} | {g: "." for g in GAPS}
        self.valid = "".join(self.complement)
        self.outside = "[^" + "".join(sorted(self.valid)).replace("-", r"\-").replace(".", r"\.") + "]"

    def fail(self, at: Column, seq: Column) -> Column:
        bad = F.substring(seq, at, F.lit(1))
        return F.raise_error(F.concat(F.lit(f"Invalid {self.name} base '"), bad, F.lit("' at position "), at.cast("string"))).cast("string")

    def reverse_complement(self, seq: Column) -> Column:
        # read from the end, so the last wrong base is the one reported
        last = F.length(seq) - F.length(F.substring_index(F.regexp_replace(seq, self.outside, "\u0001"), "\u0001", -1))
        flipped = F.translate(F.reverse(seq), self.valid, "".join(self.complement[c] for c in self.valid))
        return F.when(seq.rlike(self.outside), self.fail(last.cast("int"), seq)).otherwise(flipped)

    def pattern(self, seq: Column) -> Column:
        first = F.length(F.substring_index(F.regexp_replace(seq, self.outside, "\u0001"), "\u0001", 1)) + 1
        table = F.create_map(*[F.lit(x) for kv in self.expansion.items() for x in kv])
        letters = F.transform(F.split(seq, ""), lambda c: F.coalesce(F.try_element_at(table, c), c))
        return F.when(seq.rlike(self.outside), self.fail(first.cast("int"), seq)).otherwise(F.array_join(letters, ""))


_DNA, _RNA = _Alphabet("DNA", False), _Alphabet("RNA", True)


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sequence_dna_reverse_complement(seq: Column | str) -> Column:
    """Reverse complement with IUPAC codes, case and gaps kept; U and other letters are an error."""
    return _DNA.reverse_complement(_c(seq))


def sequence_rna_reverse_complement(seq: Column | str) -> Column:
    """Reverse complement with U in place of T."""
    return _RNA.reverse_complement(_c(seq))


def sequence_dna_as_regexp(seq: Column | str) -> Column:
    """A regular expression that matches what the IUPAC codes stand for; gaps match anything."""
    return _DNA.pattern(_c(seq))


def sequence_rna_as_regexp(seq: Column | str) -> Column:
    """As for DNA, with U."""
    return _RNA.pattern(_c(seq))


FUNCTIONS = (sequence_dna_reverse_complement, sequence_rna_reverse_complement, sequence_dna_as_regexp, sequence_rna_as_regexp)
