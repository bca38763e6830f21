"""Exact duplicates by Patricia tries over whole texts.

Each task first folds the copies among its own rows in a trie, so that a text with very many
copies is shuffled once a task at most. The folded texts go to partitions by length and content
hash, where they enter compressed radix tries; a terminal node keeps the owner (the extreme
doc_id) and the count. A trie that outgrows its memory spills its heaviest subtree's texts to the
task's own disk and handles them afterwards.
"""

from __future__ import annotations

import os
import pickle
import tempfile

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import join_counted, materialize, own_names

TRIE_BYTES = 64 << 20


class _Node:
    __slots__ = ("edge", "kids", "value", "spill")

    def __init__(self, edge: bytes):
        self.edge, self.kids, self.value, self.spill = edge, {}, None, None


class PatriciaTrie:
    """Byte strings to (owner, count); ``better(a, b)`` picks the owner of two. ``drain`` yields and empties it."""

    def __init__(self, better, most: int = TRIE_BYTES, depth: int = 0):
        self.better, self.most, self.depth = better, most, depth
        self.root, self.held = _Node(b""), 0

    def _merge(self, old, new):
        return new if old is None else (self.better(old[0], new[0]), old[1] + new[1], *old[2:])

    def add(self, key: bytes, value: tuple) -> None:
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                pickle.dump((key, value), node.spill)
                return
            if at == len(key):
                node.value = self._merge(node.value, value)
                return
            kid = node.kids.get(key[at])
            if kid is None:
                node.kids[key[at]] = kid = _Node(key[at:])
                self.held += len(kid.edge) + 200
                kid.value = value
                break
            edge = kid.edge
            if key.startswith(edge, at):
                node, at = kid, at + len(edge)
                continue
            n = _common_prefix(edge, key[at : at + len(edge)])
            # split the edge: the shared part gets a node of its own
            upper = _Node(edge[:n])
            kid.edge = edge[n:]
            upper.kids[kid.edge[0]] = kid
            node.kids[key[at]] = upper
            self.held += 200
            node, at = upper, at + n
        if self.held > self.most:
            self._spill()

    def _walk(self, node: _Node, prefix: bytes):
        stack = [(node, prefix)]
        while stack:
            x, p = stack.pop()
            if x.value is not None:
                yield p, x.value
            stack.extend((k, p + k.edge) for k in x.kids.values())

    def _spill(self) -> None:
        """Write the texts of the heaviest unspilled subtree below the first branching node to a file."""
        top = self.root
        while len(top.kids) == 1 and top.value is None and next(iter(top.kids.values())).spill is None:
            only = next(iter(top.kids.values()))
            if not only.kids:
                break
            top = only
        live = [k for k in top.kids.values() if k.spill is None]
        if not live:
            return
        weight = {id(k): sum(len(x.edge) + 200 for x in self._below(k)) for k in live}
        kid = max(live, key=lambda k: weight[id(k)])
        kid.spill = tempfile.TemporaryFile()
        above = self._prefix(top)
        for key, value in self._walk(kid, above + kid.edge):
            pickle.dump((key, value), kid.spill)
        kid.kids, kid.value = {}, None
        self.held -= weight[id(kid)]

    def _prefix(self, target: _Node) -> bytes:
        node, out = self.root, b""
        while node is not target:
            node = next(iter(node.kids.values()))
            out += node.edge
        return out

    @staticmethod
    def _below(node: _Node):
        stack = [node]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(x.kids.values())

    def drain(self):
        spills = []
        stack = [(self.root, b"")]
        while stack:
            x, p = stack.pop()
            if x.spill is not None:
                spills.append(x.spill)
                continue
            if x.value is not None:
                yield p, x.value
            stack.extend((k, p + k.edge) for k in x.kids.values())
        self.root, self.held = _Node(b""), 0
        for f in spills:
            f.seek(0)
            # deeper tries may hold more, so that texts of one shared prefix come to an end
            sub = PatriciaTrie(self.better, self.most * 2, self.depth + 1)
            while True:
                try:
                    key, value = pickle.load(f)
                except EOFError:
                    break
                sub.add(key, value)
            f.close()
            yield from sub.drain()


def _common_prefix(a: bytes, b: bytes) -> int:
    return len(os.path.commonprefix([a, b]))


def _picker(keep: str):
    """Which of two owners stays; one without an id gives way."""

    def better(a, b):
        if a is None or b is None:
            return b if a is None else a
        return max(a, b) if keep == "largest" else min(a, b)

    return better


def owners(rows: DataFrame, keep: str, most: int = TRIE_BYTES) -> DataFrame:
    """text_sha256, length, keep_id, group_size: one row a distinct text of ``rows`` (doc_id, text binary)."""
    better = _picker(keep)

    def out(items):
        got, size = [], 0
        for key, (owner, n, sha) in items:
            got.append((key, owner, n, sha))
            size += len(key)
            if size > 4 << 20:
                yield batch(got)
                got, size = [], 0
        if got:
            yield batch(got)

    def batch(got):
        text, owner, n, sha = zip(*got)
        return pa.RecordBatch.from_arrays(
            [pa.array(text, pa.binary()), pa.array(owner, pa.int64()), pa.array(n, pa.int64()), pa.array(sha, pa.string())],
            ["text", "owner", "n", "text_sha256"],
        )

    def local(batches):
        trie = PatriciaTrie(better, most * 2)
        for b in batches:
            for doc, text, sha in zip(*(c.to_pylist() for c in b.columns)):
                trie.add(text, (doc, 1, sha))
            if trie.held > most:  # before it would spill: what is folded so far goes on
                yield from out(trie.drain())
        yield from out(trie.drain())

    def final(batches):
        trie = PatriciaTrie(better, most)
        for b in batches:
            for text, doc, n, sha in zip(*(c.to_pylist() for c in b.columns)):
                trie.add(text, (doc, n, sha))
        for x in out(trie.drain()):
            lengths = pa.compute.binary_length(x.column(0))
            yield pa.RecordBatch.from_arrays([x.column(3), lengths.cast(pa.int64()), x.column(1), x.column(2)], ["text_sha256", "length", "keep_id", "group_size"])

    import pyarrow.compute  # noqa: F401

    folded = rows.mapInArrow(local, "text binary, owner long, n long, text_sha256 string")
    dealt = folded.repartition(F.length("text"), F.substring("text_sha256", 1, 16))
    return dealt.mapInArrow(final, "text_sha256 string, length long, keep_id long, group_size long")


def exact_groups(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row.

    Texts are equal when their bytes are; null counts as empty. ``keep`` says which doc_id of equal
    texts stays ("largest" or "smallest"); a null doc_id stays only where the whole group has none.
    Of repeated rows with the kept doc_id and the same text, one stays. Extra columns are ignored.
    """
    rows = own_names(
        docs,
        doc_id=F.col("doc_id").cast("long"),
        text=F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"),
    ).withColumn("text_sha256", F.sha2("text", 256))
    own = materialize(owners(rows, keep), "owners")
    n = own.agg(F.sum("group_size")).first()[0] or 0
    slim = rows.select("doc_id", "text_sha256")
    joined = join_counted(slim, own.drop("length"), "text_sha256", "group_size", n)
    return joined.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns; one of repeated rows.

    A null text is empty; rows without a doc_id stay only where their whole group has none, and then one does.
    """
    key = lambda sha: F.concat_ws(":", sha, F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")))
    kept = exact_groups(docs, keep).where("kept").select(key(F.col("text_sha256")).alias("__key")).distinct()
    # both steps need the rows dealt by one key, so texts are shuffled once
    one = docs.withColumn("__key", key(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))).dropDuplicates(["__key"])
    return one.join(kept, "__key", "left_semi").select(*docs.columns)
