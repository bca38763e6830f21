"""Standard flowgram format scans."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame

from lichenmill.types import SEQUENCE

from .base import FileSource, expand_paths, is_stdin, open_bytes, scan

LONGEST = 10 * 1024 * 1024


def _pad(n: int) -> int:
    return -n % 8


class SffSource(FileSource):
    ddl = SEQUENCE

    @classmethod
    def name(cls):
        return "sequences_sff"

    @staticmethod
    def rows(files, trim=True):
        with open_bytes(files[0]) as f:
            at = 0

            def take(n: int) -> bytes:
                nonlocal at
                b = f.read(n)
                if len(b) != n:
                    raise ValueError(f"Truncated SFF file: {files[0]}")
                at += n
                return b

            magic, version, index_at, index_size, n_reads, head, key, flows, coding = struct.unpack(">I4sQIIHHHB", take(31))
            if magic != 0x2E736666:
                raise ValueError(f"Not an SFF file (bad magic): {files[0]}")
            if version != b"\0\0\0\1" or coding != 1:
                raise ValueError(f"Unsupported SFF version or flowgram format: {files[0]}")
            take(head - 31)
            for n in range(1, n_reads + 1):
                if index_size and at == index_at:
                    take(index_size + _pad(index_size))
                size, l_name, length, ql, qr, al, ar = struct.unpack(">HHIHHHH", take(16))
                if length > LONGEST:
                    raise ValueError(f"SFF read of {length} bases is too long")
                name = take(l_name).decode()
                take(size - 16 - l_name)
                take(2 * flows + length)
                bases, quality = take(length).decode(), list(take(length))
                take(_pad(2 * flows + 3 * length))
                if max(ql, qr, al, ar) > length:
                    raise ValueError(f"SFF clip beyond the read's length: {name}")
                if trim:
                    left, right = max(ql or 1, al or 1) - 1, min(qr or length, ar or length)
                    bases, quality = bases[left : max(left, right)], quality[left : max(left, right)]
                yield n, name, None, bases, None, quality, None


def read_sequences_sff(spark, path, include_filepath: bool = False, trim: bool = True) -> DataFrame:
    """Sequences of SFF files, clipped to their quality and adapter bounds unless ``trim`` is off."""
    if is_stdin(path) or (not isinstance(path, str) and any(map(is_stdin, path))):
        raise ValueError("read_sequences_sff: stdin is not supported")
    return scan(spark, SffSource, [(f,) for f in expand_paths(path, "read_sequences_sff")], {"trim": trim}, include_filepath)
