"""Packing documents into fixed-length token sequences: first-fit decreasing on a tournament tree.

Documents longer than a sequence are cut into full pieces and a remainder. Pieces are dealt by a
keyed hash into groups of bounded expected size; each group is packed on its own, so groups run in
parallel and a lost executor costs one group. The hash takes in where a row stands in its table, so
that repeated rows are dealt like any others.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, own_names, runs
from .tokens import encoder, slices

SEQUENCE, GROUP_PIECES = 4096, 20_000


class TournamentTree:
    """Bin capacities in a complete binary tree whose inner nodes hold the larger child.

    The first bin that has room is found by walking down from the root, left child first.
    """

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1
        while self.leaves < max(1, bins):
            self.leaves *= 2
        self.node = [capacity] * (2 * self.leaves)

    def place(self, need: int) -> tuple[int, int]:
        """(bin, room it had) of the leftmost bin with room for ``need``; its room shrinks."""
        node, i = self.node, 1
        while i < self.leaves:
            i *= 2
            if node[i] < need:
                i += 1
        bin_no, room = i - self.leaves, node[i]
        node[i] = room - need
        i //= 2
        while i:
            best = max(node[2 * i], node[2 * i + 1])
            if node[i] == best:
                break
            node[i] = best
            i //= 2
        return bin_no, room


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of every size, none of which is over ``capacity``."""
    order = np.argsort(-sizes, kind="stable")
    tree = TournamentTree(len(sizes), capacity)
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in order.tolist():
        b, room = tree.place(int(sizes[i]))
        bins[i], offsets[i] = b, capacity - room
    return bins, offsets


def pieces(docs: DataFrame, tokenizer: str, end_id: int, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens [, ids]: each document's ids cut at multiples of ``sequence``.

    A null text is empty: its one piece is the end id.
    """
    rows = own_names(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text").cast("string"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids

    def cut(batches):
        enc = encoder(tokenizer)
        end = np.uint32(end_id).astype("<u4").tobytes()
        for b in batches:
            doc_ids = b.column(0).to_pylist()
            for at, texts in slices(b.column(1)):
                got = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids")}
                for k, x in enumerate(enc.encode(texts)):
                    ids = x + end
                    n = len(ids) // 4
                    for s in range(0, n, sequence):
                        piece = ids[4 * s : 4 * (s + sequence)]
                        for name, v in zip(got, (doc_ids[at + k], s, len(piece) // 4, zlib.crc32(piece), n, piece)):
                            got[name].append(v)
                kinds = {"ids": pa.binary()}
                yield pa.RecordBatch.from_pydict(
                    {k: pa.array(v, kinds.get(k, pa.int64())) for k, v in got.items() if with_ids or k != "ids"}
                )

    return rows.mapInArrow(cut, schema)


def pack(parts: DataFrame, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES, seed: int = 7) -> DataFrame:
    """Adds sequence_id, offset, sequence_tokens and padded_length to rows with doc_id, start, length.

    A sequence is padded to ``sequence`` unless its tokens are a power of two. Repeated rows are
    packed as pieces of their own; no rows give no rows. ``parts`` should be a written table: a row's
    group comes from its place there, and places that changed between two attempts could lose rows.
    """
    groups = max(1, round(parts.count() / group_pieces))
    keyed = parts.withColumn("__group", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups)))
    # order within a group is fixed, so a rerun packs alike
    keyed = keyed.repartition("__group").sortWithinPartitions("__group", "doc_id", "start", "length", "ids_crc32")
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in parts.schema)}, sequence_id long, offset long, sequence_tokens long, padded_length long"
    names = parts.columns

    def place(batches):
        for group, table in runs(batches, "__group"):
            sizes = table.column("length").to_numpy()
            bins, offsets = first_fit_decreasing(sizes, sequence)
            total = np.bincount(bins, weights=sizes).astype(np.int64)[bins]
            padded = np.where(total & (total - 1) == 0, total, sequence)
            for k, v in (("sequence_id", (int(group) << 32) + bins), ("offset", offsets), ("sequence_tokens", total), ("padded_length", padded)):
                table = table.append_column(k, pa.array(v))
            yield from table.select([*names, "sequence_id", "offset", "sequence_tokens", "padded_length"]).to_batches()

    return keyed.mapInArrow(place, schema)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Placements of all documents' pieces: see ``pieces`` and ``pack``."""
    return pack(materialize(pieces(docs, tokenizer, end_id, sequence), "pieces"), sequence, group_pieces)


def assemble(placed: DataFrame, pad_id: int = 0) -> DataFrame:
    """sequence_id, ids (padded): the sequences themselves, from placements that carry ``ids``."""
    rows = placed.select("sequence_id", "offset", "ids", "padded_length").repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")

    def join(batches):
        for key, t in runs(batches, "sequence_id"):
            ids = np.frombuffer(b"".join(t.column("ids").to_pylist()), "<u4")
            padded = np.full(t.column("padded_length")[0].as_py(), pad_id, np.int64)
            padded[: len(ids)] = ids
            yield pa.RecordBatch.from_pydict({"sequence_id": [int(key)], "ids": [padded]}, schema=out)

    out = pa.schema([("sequence_id", pa.int64()), ("ids", pa.list_(pa.int64()))])
    return rows.mapInArrow(join, "sequence_id long, ids array<long>")
