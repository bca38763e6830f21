"""Tokenizing with the tokenizers library, chunk by chunk, and flat binary token files.

File format, one set for each partition p (little-endian): ``tokens-p.bin`` all ids as uint16
(vocabularies up to 65,536) or uint32; ``offsets-p.bin`` n + 1 uint64 positions, counted from
the partition's base; ``docs-p.bin`` n int64 document ids; ``nulls-p.bin`` n bytes, 1 where the
id is null. The base of a partition is the prefix sum of the token counts before it.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from functools import lru_cache
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import own_names, scratch

#: Distinct chunks a worker keeps.
CACHE_CHUNKS = 1_200_000
#: The same where the executor also sorts whole texts and has less memory to spare.
SORTED_CACHE_CHUNKS = 800_000
#: A full cache begins anew when so many times its chunks were missed.
FORGET = 8
#: Chunks that go to the library as one text.
GROUP = 200
SLICE_CHARS = 4_000_000


class ChunkEncoder:
    """Encodes whole texts by chunks between which the tokenizer can never merge.

    The library encodes every distinct chunk; a text's ids are its chunks' ids joined. ``byte_level``:
    no normalizer and the usual byte-level pattern, where a pre-token starts at every single space and
    line break; texts with two white-space characters in a row are encoded whole. ``spaced``: a pattern
    that drops white space, so words are apart. Any other tokenizer definition is used on whole texts.

    Chunks not met lately go to the library many at a time, parted by a mark that is a token of its own;
    chunks that hold white space or the mark go one by one.
    """

    def __init__(self, path: str, cache_chunks: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.cache_chunks = cache_chunks

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.mode = self._mode(spec)
        self.vocab = self.tokenizer.get_vocab_size()
        self.known: dict[str, bytes] = {}
        self.missed = 0
        self.lead, self.mark = (" ", "\n") if self.mode == "byte_level" else ("", " | ")
        mark = self._encode([self.mark])[0] if self.mode != "whole" else b""
        self.mark_ids = mark
        self.mark_id = int(np.frombuffer(mark, "<u4")[0]) if len(mark) == 4 else None
        # lower-cased ASCII is what the plain normalizers leave of ASCII, so they need not run on it
        self.bare = None
        if self.mode == "spaced" and all("|" in t["content"] for t in spec.get("added_tokens", [])) and "Lowercase" in json.dumps(spec["normalizer"]):
            self.bare = Tokenizer.from_file(path)
            self.bare.normalizer = None

    @staticmethod
    def _mode(spec: dict) -> str:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if spec.get("truncation") or spec.get("padding"):
            return "whole"
        if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
            return "byte_level"
        steps = pre.get("pretokenizers") or [{}]
        drops = steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed"
        blanks = lambda x: x.get("type") == "Replace" and x.get("pattern") == {"Regex": r"\s+"} and x.get("content") == " "
        plain = all(x.get("type") in ("NFC", "Lowercase") or blanks(x) for x in (norm or {}).get("normalizers", []))
        later = all(x.get("type") == "ByteLevel" and not x.get("use_regex") and not x.get("add_prefix_space") for x in steps[1:])
        return "spaced" if drops and plain and later else "whole"

    def _encode(self, texts: list[str], tokenizer=None) -> list[bytes]:
        found = (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    _twice = re.compile(r"\s\s")
    _apart = re.compile(r"[\s|]")

    def _many(self, chunks: list[str], lead: str) -> list[bytes]:
        """The ids of each of ``lead`` + chunk."""
        out: list[bytes | None] = [None] * len(chunks)
        at = range(len(chunks))
        if self.mark_id is not None:
            kinds = [(at, None)]
            if self.bare is not None:
                kinds = [([i for i in at if chunks[i].isascii()], self.bare), ([i for i in at if not chunks[i].isascii()], None)]
            for some, tokenizer in kinds:
                odd = self._joined(chunks, some, lead, tokenizer, out)
                plain = [i for i in odd if chunks[i] and not self._apart.search(chunks[i])]
                if plain:
                    self._joined(chunks, plain, lead, tokenizer, out)
        rest = [i for i in at if out[i] is None]
        for i, ids in zip(rest, self._encode([lead + chunks[i] for i in rest])):
            out[i] = ids
        return out

    def _joined(self, chunks: list[str], at, lead: str, tokenizer, out: list) -> list[int]:
        """Encode the chunks ``at`` these places many at a time; the places of groups that cannot be cut apart again are returned."""
        groups, odd = [], []
        for a in range(0, len(at), GROUP):
            places = at[a : a + GROUP]
            words = [chunks[i] for i in places]
            if self._apart.search("".join(words)) or "" in words:
                odd += places
            else:
                groups.append((places, (self.mark + lead).join(words)))
        texts = [lead + j.lower() if tokenizer else lead + j for _, j in groups]
        for (places, _), raw in zip(groups, self._encode(texts, tokenizer)):
            cut = (np.flatnonzero(np.frombuffer(raw, "<u4") == self.mark_id) * 4).tolist()
            if len(cut) != len(places) - 1:
                odd += places
                continue
            for i, a, z in zip(places, [0, *(c + 4 for c in cut)], [*cut, len(raw)]):
                out[i] = raw[a:z]
        return odd

    def _fill(self, chunks: list[str]) -> list[bytes]:
        """The ids of distinct chunks that the cache lacks; one that begins with a line break has no space before its word.

        The cache takes in chunks until it is full. The most frequent ones are among the first met, and
        the rare ones would but push each other out; once as many again have been missed FORGET times,
        it begins anew, so that a worker which has come to other texts learns their words.
        """
        if self.mode == "byte_level":
            lines, words = [c[1:] for c in chunks if c[:1] == "\n"], [c for c in chunks if c[:1] != "\n"]
            lines, words = iter(self._many(lines, "")), iter(self._many(words, self.lead))
            ids = [self.mark_ids + next(lines) if c[:1] == "\n" else next(words) for c in chunks]
        else:
            ids = self._many(chunks, self.lead)
        if len(self.known) < self.cache_chunks:
            self.known.update(zip(chunks, ids))
            return ids
        self.missed += len(chunks)
        if self.missed > FORGET * self.cache_chunks:
            self.known, self.missed = {}, 0
        return ids

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian uint32 bytes.

        Arrow splits the texts and numbers their distinct chunks; only these are looked up or go to the
        library, and their ids are dealt out by number.
        """
        if self.mode == "whole":
            return self._encode(texts)
        out: list[bytes] = [b""] * len(texts)
        whole = [i for i, t in enumerate(texts) if self._twice.search(t)] if self.mode == "byte_level" else []
        apart = set(whole)
        some = [i for i in range(len(texts)) if i not in apart]
        for i, v in zip(whole, self._encode([texts[i] for i in whole])):
            out[i] = v
        column = pa.array([texts[i] for i in some], pa.string())
        if self.mode == "spaced":
            split = pc.ascii_split_whitespace(column)
        else:
            split = pc.split_pattern(pc.replace_substring(column, "\n", " \n"), " ")
        at, chunks = split.offsets.to_numpy(), split.flatten()
        coded = chunks.dictionary_encode()
        keys = coded.dictionary.to_pylist()
        ids = list(map(self.known.get, keys))
        if None in ids:
            missed = [k for k, v in zip(keys, ids) if v is None]
            found = iter(self._fill(missed))
            ids = [next(found) if v is None else v for v in ids]
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) // 4
        by_key = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(np.frombuffer(b"".join(ids), np.uint32)))
        dealt = by_key.take(coded.indices)
        data, word_at = dealt.flatten().to_numpy().astype("<u4").tobytes(), dealt.offsets.to_numpy().astype(np.int64)
        word_at = 4 * (word_at - word_at[0])
        heads = [b""] * len(some)
        if self.mode == "byte_level":  # a text's first chunk has no space before it
            heads, starts = self._many(chunks.take(pa.array(at[:-1])).to_pylist(), ""), word_at[at[:-1] + 1]
        else:
            starts = word_at[at[:-1]]
        for i, head, a, z in zip(some, heads, starts.tolist(), word_at[at[1:]].tolist()):
            out[i] = head + data[a:z]
        return out


@lru_cache(maxsize=4)
def encoder(path: str, cache_chunks: int = CACHE_CHUNKS) -> ChunkEncoder:
    """One encoder a worker process, its caches kept from task to task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ChunkEncoder(path, cache_chunks)


def slices(column: pa.Array, most: int = SLICE_CHARS):
    """(first row, texts) of at most about ``most`` characters; null is the empty text."""
    start, texts, size = 0, [], 0
    for i in range(len(column)):
        t = column[i].as_py() or ""
        texts.append(t)
        size += len(t)
        if size >= most:
            yield start, texts
            start, texts, size = i + 1, [], 0
    if texts:
        yield start, texts


def local_path(uri: str) -> str | None:
    """The path of a file: URI or plain path; None for a remote store."""
    u = urlparse(uri)
    return unquote(u.path) if u.scheme in ("", "file") else None


class _Sink:
    """Streams one flat file of a partition, so that memory does not grow with it."""

    def __init__(self, folder: str, name: str):
        # an attempt writes under a name of its own, so that one which dies or comes second tears nothing
        part = f".{name}.{TaskContext.get().taskAttemptId()}"
        at = local_path(folder)
        if at is None:
            import pyarrow.fs

            self.fs, root = pyarrow.fs.FileSystem.from_uri(folder)
            self.part, self.final = f"{root}/{part}", f"{root}/{name}"
            self.file = self.fs.open_output_stream(self.part)
        else:
            os.makedirs(at, exist_ok=True)
            self.fs, self.part, self.final = None, f"{at}/{part}", f"{at}/{name}"
            self.file = open(self.part, "wb")

    def write(self, a: np.ndarray) -> None:
        self.file.write(a.tobytes())

    def close(self) -> None:
        self.file.close()
        (self.fs.move if self.fs else os.replace)(self.part, self.final)


def fetch(folder: str, name: str, dtype: str) -> np.ndarray:
    """A flat file as an array, memory-mapped where the store is a file system."""
    at = local_path(folder)
    if at is None:
        import pyarrow.fs

        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        with fs.open_input_file(f"{root}/{name}") as f:
            return np.frombuffer(f.read(), dtype)
    if not os.path.getsize(f"{at}/{name}"):
        return np.empty(0, dtype)
    return np.memmap(f"{at}/{name}", dtype=dtype, mode="r")


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> tuple[str, list[dict]]:
    """Encode all texts in ascending doc_id order into token files; (folder, manifest by partition).

    A null text is empty, so only the end id is written. A null doc_id sorts first; rows of equal
    doc_id follow in the order of their texts' hashes. No documents give no files.
    """
    spark = docs.sparkSession
    folder = folder or scratch(spark, "token-files")
    rows = own_names(docs, doc_id=F.col("doc_id").cast("long"), text=F.col("text").cast("string"), tie=F.xxhash64("text"))
    rows = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def write(batches):
        enc = encoder(tokenizer, SORTED_CACHE_CHUNKS)
        width = "<u2" if max(enc.vocab, end_id + 1) <= 65536 else "<u4"
        p = TaskContext.get().partitionId()
        sinks = None
        n = total = 0
        for b in batches:
            if not b.num_rows:
                continue
            if sinks is None:
                sinks = {k: _Sink(folder, f"{k}-{p:05d}.bin") for k in ("tokens", "offsets", "docs", "nulls")}
                sinks["offsets"].write(np.zeros(1, "<u8"))
            ids = b.column(0)
            sinks["docs"].write(ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"))
            sinks["nulls"].write(np.asarray(ids.is_null()).astype("u1"))
            for _, texts in slices(b.column(1)):
                for x in enc.encode(texts):
                    a = np.append(np.frombuffer(x, "<u4"), np.uint32(end_id))
                    sinks["tokens"].write(a.astype(width))
                    total += len(a)
                    n += 1
                    sinks["offsets"].write(np.array([total], "<u8"))
        if sinks:
            for s in sinks.values():
                s.close()
            yield pa.RecordBatch.from_pydict({"part": [p], "docs": [n], "tokens": [total], "width": [width]}, schema=out)

    out = pa.schema([("part", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("width", pa.string())])
    found = rows.mapInArrow(write, "part int, docs long, tokens long, width string").collect()  # one row a partition
    manifest, base = [], 0
    for r in sorted(found, key=lambda r: r.part):
        manifest.append({"part": r.part, "docs": r.docs, "tokens": r.tokens, "width": r.width, "base": base})
        base += r.tokens
    return folder, manifest


def read_token_files(spark, folder: str, manifest: list[dict]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from memory-mapped token files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not manifest:
        return spark.createDataFrame([], schema)
    parts = spark.sparkContext.broadcast(manifest)  # one small entry a partition

    def read(batches):
        for b in batches:
            for k in b.column(0).to_pylist():
                m = parts.value[k]
                p = f"{m['part']:05d}"
                ids, at = fetch(folder, f"tokens-{p}.bin", m["width"]), fetch(folder, f"offsets-{p}.bin", "<u8").astype(np.int64)
                docs, null = fetch(folder, f"docs-{p}.bin", "<i8"), fetch(folder, f"nulls-{p}.bin", "u1").astype(bool)
                for a in range(0, m["docs"], 20_000):
                    z = min(a + 20_000, m["docs"])
                    crc = [zlib.crc32(ids[i:j].astype("<u4").tobytes()) for i, j in zip(at[a:z].tolist(), at[a + 1 : z + 1].tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs[a:z], mask=null[a:z]), pa.array(at[a:z] + m["base"]), pa.array(at[a + 1 : z + 1] - at[a:z]), pa.array(crc, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return spark.range(0, len(manifest), 1, len(manifest)).mapInArrow(read, schema)
