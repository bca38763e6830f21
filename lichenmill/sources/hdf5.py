"""A small HDF5 reader and writer: superblock 0, symbol-table groups, version 1 object headers.

Reads contiguous, compact and chunked datasets (deflate, shuffle, checksum) of integers, floats,
fixed and variable strings, and attributes of those; writes the same without shuffle. That is what
feature-table files need.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89HDF\r\n\x1a\n"
NONE = 0xFFFFFFFFFFFFFFFF
LEAF_K, INNER_K, CHUNK_K = 16, 16, 32


class Hdf5Error(ValueError):
    pass


# --- reading -------------------------------------------------------------------------------------


class File:
    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE:
            raise Hdf5Error("not an HDF5 file")
        if data[8] not in (0, 1) or data[13] != 8 or data[14] != 8:
            raise Hdf5Error(f"unsupported HDF5 superblock version {data[8]}")
        self.data = data
        at = 24 + (4 if data[8] == 1 else 0) + 32
        self.root = Object(self, struct.unpack_from("<Q", data, at + 8)[0])

    def __getitem__(self, path: str) -> "Object":
        node = self.root
        for part in path.strip("/").split("/"):
            kids = node.children()
            if part not in kids:
                raise Hdf5Error(f"no object {path}")
            node = kids[part]
        return node


def _pad8(n: int) -> int:
    return -n % 8


class Object:
    def __init__(self, file: File, at: int):
        self.file, self.at = file, at
        self.messages = list(self._messages())

    def _messages(self):
        d = self.file.data
        if d[self.at : self.at + 4] == b"OHDR" or d[self.at] != 1:
            raise Hdf5Error("unsupported object header version")
        total, size = struct.unpack_from("<H", d, self.at + 2)[0], struct.unpack_from("<I", d, self.at + 8)[0]
        spans, seen = [(self.at + 16, size)], 0
        while spans and seen < total:
            at, left = spans.pop(0)
            end = at + left
            while at + 8 <= end and seen < total:
                kind, size = struct.unpack_from("<HH", d, at)
                body = d[at + 8 : at + 8 + size]
                seen += 1
                if kind == 0x10:
                    spans.append(struct.unpack("<QQ", body[:16]))
                else:
                    yield kind, body
                at += 8 + size

    def _first(self, kind: int) -> bytes | None:
        return next((b for k, b in self.messages if k == kind), None)

    def children(self) -> dict[str, "Object"]:
        table = self._first(0x11)
        if table is None:
            return {}
        d = self.file.data
        tree, heap = struct.unpack("<QQ", table[:16])
        names = struct.unpack_from("<Q", d, heap + 24)[0]
        out = {}
        stack = [tree]
        while stack:
            at = stack.pop()
            if d[at : at + 4] == b"TREE":
                n = struct.unpack_from("<H", d, at + 6)[0]
                stack.extend(struct.unpack_from("<Q", d, at + 32 + 16 * i)[0] for i in range(n))
            else:
                n = struct.unpack_from("<H", d, at + 6)[0]
                for i in range(n):
                    name, head = struct.unpack_from("<QQ", d, at + 8 + 40 * i)
                    end = d.index(0, names + name)
                    out[d[names + name : end].decode()] = Object(self.file, head)
        return out

    def attributes(self) -> dict:
        out = {}
        for kind, b in self.messages:
            if kind != 0x0C:
                continue
            version, n_name, n_type, n_space = b[0], *struct.unpack_from("<HHH", b, 2)
            at = 8 if version < 3 else 9
            step = (lambda n: n + _pad8(n)) if version == 1 else (lambda n: n)
            name = b[at : at + n_name].split(b"\0")[0].decode()
            at += step(n_name)
            kind_ = Type(b[at : at + n_type])
            at += step(n_type)
            shape = _shape(b[at : at + n_space])
            values = kind_.decode(self.file.data, b[at + step(n_space) :], int(np.prod(shape, dtype=np.int64)))
            out[name] = values[0] if not shape and len(values) else values
        return out

    def read(self):
        """All values of a dataset: an array, or a list of strings."""
        shape, kind, layout = _shape(self._first(0x01)), Type(self._first(0x03)), self._first(0x08)
        n = int(np.prod(shape, dtype=np.int64))
        d = self.file.data
        if layout is None or layout[0] != 3:
            raise Hdf5Error("unsupported dataset layout")
        if layout[1] == 0:
            size = struct.unpack_from("<H", layout, 2)[0]
            return kind.decode(d, layout[4 : 4 + size], n)
        if layout[1] == 1:
            at, size = struct.unpack_from("<QQ", layout, 2)
            return kind.decode(d, b"" if at == NONE else d[at : at + size], n)
        rank, tree = layout[2], struct.unpack_from("<Q", layout, 3)[0]
        if rank != 2:
            raise Hdf5Error("only one-dimensional chunked datasets are supported")
        chunk, item = struct.unpack_from("<II", layout, 11)
        raw = bytearray(n * item)
        for at, size, offset in self._chunks(tree):
            part = self._unfilter(d[at : at + size], item)
            lo = offset * item
            raw[lo : min(len(raw), lo + chunk * item)] = part[: max(0, min(chunk * item, len(raw) - lo))]
        return kind.decode(d, bytes(raw), n)

    def _chunks(self, tree: int):
        d, stack = self.file.data, [tree]
        while stack:
            at = stack.pop()
            if at == NONE:
                continue
            level, n = d[at + 5], struct.unpack_from("<H", d, at + 6)[0]
            for i in range(n):
                key = at + 24 + i * 32
                size, _, offset, _, child = struct.unpack_from("<IIQQQ", d, key)
                if level:
                    stack.append(child)
                else:
                    yield child, size, offset

    def _unfilter(self, part: bytes, item: int) -> bytes:
        pipe = self._first(0x0B)
        if pipe is None:
            return part
        version, n = pipe[0], pipe[1]
        at, kinds = (8 if version == 1 else 2), []
        for _ in range(n):
            kind, n_name = struct.unpack_from("<HH", pipe, at)
            if version == 2 and kind < 256:
                n_name, n_values, at = 0, struct.unpack_from("<H", pipe, at + 4)[0], at + 6
            else:
                n_values, at = struct.unpack_from("<H", pipe, at + 6)[0], at + 8
            at += n_name + 4 * n_values + (4 if version == 1 and n_values % 2 else 0)
            kinds.append(kind)
        for kind in reversed(kinds):
            if kind == 1:
                part = zlib.decompress(part)
            elif kind == 2:
                part = np.frombuffer(part, np.uint8).reshape(item, -1).T.tobytes()
            elif kind == 3:
                part = part[:-4]
            else:
                raise Hdf5Error(f"unsupported HDF5 filter {kind}")
        return part


def _shape(b: bytes) -> tuple:
    at = 8 if b[0] == 1 else 4
    return struct.unpack_from(f"<{b[1]}Q", b, at)


class Type:
    def __init__(self, b: bytes):
        self.kind, self.bits, self.size = b[0] & 15, int.from_bytes(b[1:4], "little"), struct.unpack_from("<I", b, 4)[0]
        self.string = self.kind == 9 and self.bits & 15 == 1
        end = ">" if self.bits & 1 else "<"
        if self.kind == 0:
            self.dtype = np.dtype(f"{end}{'i' if self.bits & 8 else 'u'}{self.size}")
        elif self.kind == 1:
            self.dtype = np.dtype(f"{end}f{self.size}")
        elif self.kind not in (3, 9):
            raise Hdf5Error(f"unsupported HDF5 type class {self.kind}")

    def decode(self, data: bytes, raw: bytes, n: int):
        if self.kind in (0, 1):
            return np.frombuffer(raw, self.dtype, n)
        if self.kind == 3:
            return [raw[i * self.size : (i + 1) * self.size].split(b"\0")[0].decode() for i in range(n)]
        heaps: dict[int, dict[int, bytes]] = {}
        out = []
        for i in range(n):
            size, heap, index = struct.unpack_from("<IQI", raw, 16 * i)
            if size == 0 or heap in (0, NONE):
                out.append("")
                continue
            if heap not in heaps:
                heaps[heap] = _collection(data, heap)
            out.append(heaps[heap][index][:size].decode())
        return out


def _collection(d: bytes, at: int) -> dict[int, bytes]:
    end, out = at + struct.unpack_from("<Q", d, at + 8)[0], {}
    at += 16
    while at + 16 <= end:
        index, _, _, size = struct.unpack_from("<HHIQ", d, at)
        if index == 0:
            break
        out[index] = d[at + 16 : at + 16 + size]
        at += 16 + size + _pad8(size)
    return out


# --- writing -------------------------------------------------------------------------------------

_F64 = bytes([0x11, 0x20, 0x3F, 0]) + struct.pack("<IHHBBBBI", 8, 0, 64, 52, 11, 0, 52, 1023)
_STR = bytes([0x19, 0x01, 0x01, 0]) + struct.pack("<I", 16) + bytes([0x13, 0x10, 0, 0]) + struct.pack("<I", 1)


def _int(size: int) -> bytes:
    return bytes([0x10, 0x08, 0, 0]) + struct.pack("<IHH", size, 0, 8 * size)


def _space(shape: tuple) -> bytes:
    return struct.pack("<BBBB4x", 1, len(shape), 0, 0) + struct.pack(f"<{len(shape)}Q", *shape)


class Writer:
    """Collects blocks; a group is a dict of names, a dataset an array or a list of strings."""

    def __init__(self) -> None:
        self.out = bytearray(96)

    def put(self, block: bytes) -> int:
        self.out += b"\0" * _pad8(len(self.out))
        at = len(self.out)
        self.out += block
        return at

    def header(self, messages: list[tuple[int, bytes]]) -> int:
        body = b""
        for kind, b in messages:
            b += b"\0" * _pad8(len(b))
            body += struct.pack("<HHB3x", kind, len(b), 0) + b
        return self.put(struct.pack("<BxHII4x", 1, len(messages), 1, len(body)) + body)

    def strings(self, values: list[str]) -> bytes:
        """Put strings into global heaps; their references."""
        refs, at = [], 0
        while at < len(values):
            part, size = [], 16
            while at + len(part) < len(values) and len(part) < 60_000 and size < 1 << 20:
                b = values[at + len(part)].encode()
                part.append(b)
                size += 16 + len(b) + _pad8(len(b))
            body = b"".join(struct.pack("<HHIQ", i + 1, 1, 0, len(b)) + b + b"\0" * _pad8(len(b)) for i, b in enumerate(part))
            whole = max(4096, 16 + len(body) + 16)
            free = whole - 16 - len(body)
            heap = self.put(b"GCOL" + struct.pack("<B3xQ", 1, whole) + body + struct.pack("<HHIQ", 0, 0, 0, free) + b"\0" * (free - 16))
            refs += [struct.pack("<IQI", len(b), heap, i + 1) for i, b in enumerate(part)]
            at += len(part)
        return b"".join(refs)

    def encode(self, value) -> tuple[bytes, tuple, bytes]:
        """(type, shape, bytes) of an attribute or dataset value."""
        if isinstance(value, str):
            return _STR, (), self.strings([value])
        if isinstance(value, list) and (not value or isinstance(value[0], str)):
            return _STR, (len(value),), self.strings(value)
        a = np.asarray(value)
        if a.dtype.kind == "f":
            return _F64, a.shape, a.astype("<f8").tobytes()
        return _int(a.dtype.itemsize), a.shape, a.astype(a.dtype.newbyteorder("<")).tobytes()

    def attribute(self, name: str, value) -> tuple[int, bytes]:
        kind, shape, raw = self.encode(value)
        pad = lambda b: b + b"\0" * _pad8(len(b))
        n, space = name.encode() + b"\0", _space(shape)
        return 0x0C, struct.pack("<BxHHH", 1, len(n), len(kind), len(space)) + pad(n) + pad(kind) + pad(space) + raw

    def dataset(self, value, compress: bool) -> int:
        kind, shape, raw = self.encode(value)
        item = struct.unpack_from("<I", kind, 4)[0]
        messages = [(0x01, _space(shape)), (0x03, kind), (0x05, bytes([2, 2, 2, 0]))]
        if not compress or not raw:
            at = self.put(raw) if raw else NONE
            return self.header([*messages, (0x08, struct.pack("<BBQQ", 3, 1, at, len(raw)))])
        chunk = max(1 << 16, -(-shape[0] // (2 * CHUNK_K)))
        chunk = min(chunk, shape[0])
        keys = b""
        n = 0
        for lo in range(0, shape[0], chunk):
            part = raw[lo * item : (lo + chunk) * item].ljust(chunk * item, b"\0")
            packed = zlib.compress(part, 4)
            keys += struct.pack("<IIQQQ", len(packed), 0, lo, 0, self.put(packed))
            n += 1
        node = b"TREE" + struct.pack("<BBHQQ", 1, 0, n, NONE, NONE) + keys + struct.pack("<IIQQ", 0, 0, n * chunk, 0)
        tree = self.put(node.ljust(24 + 2 * CHUNK_K * 8 + (2 * CHUNK_K + 1) * 24, b"\0"))
        layout = struct.pack("<BBBQII", 3, 2, 2, tree, chunk, item)
        pipe = struct.pack("<BB6x", 1, 1) + struct.pack("<HHHHI4x", 1, 0, 1, 1, 4)
        return self.header([*messages, (0x0B, pipe), (0x08, layout)])

    def group(self, children: dict[str, int], attributes: dict | None = None) -> tuple[int, int, int]:
        """(object header, tree, heap) of a group of up to 2 * LEAF_K objects."""
        names, offsets = b"\0" * 8, {}
        for name in sorted(children):
            offsets[name] = len(names)
            b = name.encode() + b"\0"
            names += b + b"\0" * _pad8(len(b))
        segment = self.put(names)
        heap = self.put(b"HEAP" + struct.pack("<B3xQQQ", 0, len(names), 1, segment))
        entries = b"".join(struct.pack("<QQII16x", offsets[n], children[n], 0, 0) for n in sorted(children))
        leaf = self.put((b"SNOD" + struct.pack("<BxH", 1, len(children)) + entries).ljust(8 + 2 * LEAF_K * 40, b"\0"))
        last = offsets[max(children)] if children else 0
        used = 1 if children else 0
        node = b"TREE" + struct.pack("<BBHQQ", 0, 0, used, NONE, NONE) + struct.pack("<QQQ", 0, leaf, last)
        tree = self.put(node.ljust(24 + 2 * INNER_K * 8 + (2 * INNER_K + 1) * 8, b"\0"))
        messages = [(0x11, struct.pack("<QQ", tree, heap)), *(self.attribute(k, v) for k, v in (attributes or {}).items())]
        return self.header(messages), tree, heap

    def finish(self, root: tuple[int, int, int]) -> bytes:
        self.out += b"\0" * _pad8(len(self.out))
        head, tree, heap = root
        block = SIGNATURE + bytes([0, 0, 0, 0, 0, 8, 8, 0]) + struct.pack("<HHI", LEAF_K, INNER_K, 0)
        block += struct.pack("<QQQQ", 0, NONE, len(self.out), NONE) + struct.pack("<QQIIQQ", 0, head, 1, 0, tree, heap)
        self.out[:96] = block
        return bytes(self.out)
