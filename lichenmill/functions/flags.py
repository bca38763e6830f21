"""SAM flag predicates: one bit test each, NULL for NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bit of each predicate and its short name.
BITS = {
    "alignment_is_paired": (0x1, "is_paired"),
    "alignment_is_proper_pair": (0x2, "is_proper_pair"),
    "alignment_is_unmapped": (0x4, "is_unmapped"),
    "alignment_is_mate_unmapped": (0x8, "is_munmap"),
    "alignment_is_reverse": (0x10, "is_reverse"),
    "alignment_is_mate_reverse": (0x20, "is_mreverse"),
    "alignment_is_read1": (0x40, "is_read1"),
    "alignment_is_read2": (0x80, "is_read2"),
    "alignment_is_secondary": (0x100, "is_secondary"),
    "alignment_is_qc_failed": (0x200, "is_qcfail"),
    "alignment_is_duplicate": (0x400, "is_dup"),
    "alignment_is_supplementary": (0x800, "is_supplementary"),
}


def _checked(flags: Column) -> Column:
    """Flags outside 0..65535 are an error, as a cast to an unsigned 16-bit number is."""
    ok = flags.isNull() | flags.between(0, 65535)
    return F.when(ok, flags.cast("int")).otherwise(F.raise_error(F.concat(F.lit("flags out of range of USMALLINT: "), flags.cast("string"))).cast("int"))


def has_any(flags: Column | str, mask: int) -> Column:
    return _checked(F.col(flags) if isinstance(flags, str) else flags).bitwiseAND(mask) != 0


def _predicate(name: str, mask: int):
    def f(flags: Column | str) -> Column:
        return has_any(flags, mask)

    f.__name__ = f.__qualname__ = name
    f.__doc__ = f"True where bit {mask:#x} of the SAM flags is set."
    return f


for _name, (_mask, _short) in BITS.items():
    globals()[_name] = globals()[_short] = _predicate(_name, _mask)


def alignment_is_primary(flags: Column | str) -> Column:
    """True where the alignment is neither secondary nor supplementary."""
    return ~has_any(flags, 0x100 | 0x800)


#: Every predicate by name, short names included; the primary test has no short name.
PREDICATES = {n: globals()[n] for name, (_, short) in BITS.items() for n in (name, short)} | {"alignment_is_primary": alignment_is_primary}
