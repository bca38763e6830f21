"""A writer of small SFF files, for examples and tests."""

from __future__ import annotations

import struct


def build_sff(reads: list[tuple[str, str, list[int], int, int]], flows: int = 4, index: bytes = b"") -> bytes:
    """SFF of (name, bases, qualities, quality clip left, right) reads, 1-based clips, 0 for none."""
    head = 31 + flows + 4
    head += -head % 8
    body = b""
    for name, bases, quals, left, right in reads:
        size = 16 + len(name)
        size += -size % 8
        h = struct.pack(">HHIHHHH", size, len(name), len(bases), left, right, 0, 0) + name.encode()
        data = b"\0\1" * flows + b"\1" * len(bases) + bases.encode() + bytes(quals)
        body += h.ljust(size, b"\0") + data + b"\0" * (-len(data) % 8)
    at = head + len(body) if index else 0
    common = struct.pack(">I4sQIIHHHB", 0x2E736666, b"\0\0\0\1", at, len(index), len(reads), head, 4, flows, 1) + b"TACG"[:flows].ljust(flows, b"T") + b"TCAG"
    return common.ljust(head, b"\0") + body + index + b"\0" * (-len(index) % 8)
