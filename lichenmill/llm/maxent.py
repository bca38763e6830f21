"""Language model: hashed maximum entropy with n-gram and skip features and a class-factored softmax.

log P(word | context) = log P(class | context) + log P(cell | class, context) + log P(word | cell). The
class factor is a softmax over CLASSES whose logits add up hashed weight rows of the bigram, trigram
and skip contexts and a bias; the cell factor one over the CELLS of the class, whose logits are the
hashed weight row of the class and the word before, and the class's biases. The word factor is the
closed-form maximum-likelihood solution of a softmax of biases only: relative counts, discounted by
the cell's share of words seen once, which goes to unseen words. All unseen words of a cell are one
symbol, as they are one in the unigram base, so that the symbols' probabilities sum to one after every
context. Classes are stretches of equal training mass of word endings and cells are bits of the word's
hash, so neither needs a vocabulary.

Words are known by a 64-bit polynomial hash computed over whole byte blocks; with V distinct
words, V * V / 2**65 pairs are expected to collide (3e-4 for a hundred million).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import LOWER_BYTES, materialize, own_names

CLASSES = 32
#: Weight rows: bigram, trigram, skip contexts, then one row for the bias.
SIZES = (1 << 13, 1 << 14, 1 << 13)
BASES = (0, SIZES[0], SIZES[0] + SIZES[1])
ROWS = sum(SIZES) + 1
#: Cells of a class, and their weight rows: class and word before, then one row of biases for each class.
CELLS, CELL_SIZE = 16, 1 << 15
CELL_ROWS = CELL_SIZE + CLASSES
#: Words frequent enough to be broadcast with their counts; the others are joined.
HEAD = 1 << 18
BLOCK, SEGMENT, BATCH, RATE = 1 << 20, 1 << 22, 4096, 0.15

_MUL = 0x9E3779B97F4A7C13  # odd, and 3 modulo 4, so that powers of it are far apart modulo 2**64
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
END, BEGIN = np.uint64(0xE0D0000000000001), np.uint64(0xBE60000000000001)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(20, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        table = lambda r: np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size - 1, r, np.uint64)]))
        _powers[size] = table(_MUL), table(pow(_MUL, -1, 1 << 64))
    return _powers[size]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def word_hashes(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, hash, ending) of each word of a byte block; ending is its last two bytes."""
    word = ~_SPACE[flat]
    edge = np.diff(np.concatenate([[False], word, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _power_tables(len(flat) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * up[: len(flat)])])
    hashes = _mix((sums[ends] - sums[starts]) * down[starts])
    before = np.where(ends - starts > 1, flat[ends - 2], 0).astype(np.int32)
    return starts, hashes, flat[ends - 1].astype(np.int32) * 256 + before


class Block:
    """Tokens of some rows: hash, ending (-1 for the end token), row of each, and which begin a text.

    ``before`` has the last two tokens ahead of the first piece where that goes on with a text.
    """

    def __init__(self, pieces: list[tuple[int, bytes, bool]], before: tuple[np.uint64, np.uint64] | None = None):
        flat = np.frombuffer(b" ".join(p[1] for p in pieces).translate(LOWER_BYTES), np.uint8)
        sizes = np.array([len(p[1]) + 1 for p in pieces])
        at = np.cumsum(sizes) - sizes
        starts, hashes, endings = word_hashes(flat)
        piece = np.searchsorted(at, starts, "right") - 1
        last = np.array([p[2] for p in pieces])
        ends_before = np.cumsum(last) - last
        words = np.bincount(piece, minlength=len(pieces))
        n = len(starts) + int(last.sum())
        self.hash, self.ending, self.row = np.full(n, END), np.full(n, -1, np.int32), np.empty(n, np.int64)
        place = np.arange(len(starts)) + ends_before[piece]
        rows = np.array([p[0] for p in pieces])
        self.hash[place], self.ending[place], self.row[place] = hashes, endings, rows[piece]
        self.row[(np.cumsum(words) + ends_before)[last]] = rows[last]
        first = np.zeros(n, bool)
        begin = (np.cumsum(words) - words + ends_before)[(words > 0) | last]
        first[begin] = True
        if before is not None and n:
            first[0] = False
        self.first, self.before = first, before or (BEGIN, BEGIN)

    def previous(self) -> np.ndarray:
        one = np.concatenate([[self.before[0]], self.hash[:-1]])[: len(self.hash)]
        one[self.first] = BEGIN
        return one

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Weight rows of the bigram, trigram and skip context of each token, each from 0."""
        one = self.previous()
        two = np.concatenate([[self.before[1]], one[:-1]])[: len(one)]
        two[self.first] = BEGIN
        cut = lambda h, size: (h >> np.uint64(65 - size.bit_length())).astype(np.uint16)
        return (
            cut(_mix(one * np.uint64(0xA24BAED4963EE407)), SIZES[0]),
            cut(_mix(one * np.uint64(0x9FB21C651E98DF25) + two * np.uint64(0xC2B2AE3D27D4EB4F)), SIZES[1]),
            cut(_mix(two * np.uint64(0xFF51AFD7ED558CCD)), SIZES[2]),
        )


def cell_rows(previous: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Weight row of the cell factor of each token, from the word before it and its class."""
    h = _mix(previous * np.uint64(0xB492B66FBE98F273) + classes.astype(np.uint64) * np.uint64(0x9AE16A3B2F90404F))
    return (h >> np.uint64(65 - CELL_SIZE.bit_length())).astype(np.uint16)


def cell_of(hashes: np.ndarray) -> np.ndarray:
    """Cell of each word in its class; the end token is alone in its class, whose cell factor is 1."""
    return (hashes >> np.uint64(9)).astype(np.int64) & (CELLS - 1)


_space = re.compile(rb"[\x20\x09-\x0D]")


def blocks(column: pa.Array):
    """Blocks of about BLOCK bytes; a longer text is cut at white space, and its contexts go on over the cuts."""
    held, size = [], 0
    for i in range(len(column)):
        text = column[i].as_py() or b""
        at, before = 0, None
        while len(text) - at > SEGMENT and (m := _space.search(text, at + SEGMENT)):
            x = Block([(i, text[at : m.start()], False)], before)
            if len(x.hash):
                before = x.hash[-1], x.previous()[-1]
                yield x
            at = m.end()
        if before is not None:
            yield Block([(i, text[at:], True)], before)
            continue
        held.append((i, text[at:], True))
        size += len(text) - at
        if size >= BLOCK:
            yield Block(held)
            held, size = [], 0
    if held:
        yield Block(held)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, slot: the remainder of crc32(doc_id as text) by 7, which sets apart what is held out (null: 0)."""
    rows = own_names(docs, doc_id=F.col("doc_id").cast("long"), text=F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    return rows.withColumn("slot", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7, F.lit(0)).cast("int"))


def count_words(rows: DataFrame) -> DataFrame:
    """word (hash as a long), ending, n over ``rows`` (text binary)."""

    def count(batches):
        held, size = [], 0

        def flush():
            words, at, n = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_inverse=False, return_counts=True)
            endings = np.concatenate([h[1] for h in held])[at]
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(endings), pa.array(n.astype(np.int64))], ["word", "ending", "n"])

        for b in batches:
            for x in blocks(b.column(0)):
                held.append((x.hash, x.ending))
                size += len(x.hash)
                if size > 4_000_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    partial = rows.select("text").mapInArrow(count, "word long, ending int, n long")
    return partial.groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


def _classes(mass: np.ndarray) -> np.ndarray:
    """Class of each ending: class 0 is the end token's, the others are stretches of near equal mass."""
    upto = np.cumsum(mass) - mass / 2
    return (1 + np.minimum(CLASSES - 2, (upto / max(1.0, mass.sum()) * (CLASSES - 1)).astype(np.int64))).astype(np.uint8)


def class_of(ending: np.ndarray, table: np.ndarray) -> np.ndarray:
    return np.where(ending < 0, 0, table[np.maximum(ending, 0)])


def probabilities(w: np.ndarray, f: tuple) -> np.ndarray:
    """Class probabilities of each token's context."""
    z = w[f[0]] + w[f[1] + np.int32(BASES[1])] + w[f[2] + np.int32(BASES[2])] + w[ROWS - 1]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def cell_probabilities(w: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Probabilities of the cells of each token's class."""
    z = w[rows] + w[CELL_SIZE + classes]
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


class _Descent:
    """Weights that descend, with what each row has moved by and how often it was met."""

    def __init__(self, start: np.ndarray):
        self.start, self.w = start, start.copy()
        self.square, self.met = np.full(len(start), 1e-2, np.float32), np.zeros(len(start), np.int64)

    def step(self, rows: np.ndarray, g: np.ndarray, base: int = 0) -> None:
        """Move each row, counted from ``base``, by its summed gradient; numbers of 16 bits are sorted by radix."""
        order = np.argsort(rows, kind="stable")
        sorted_ = rows[order]
        cut = np.concatenate([[0], np.flatnonzero(sorted_[1:] != sorted_[:-1]) + 1])
        move, row = np.add.reduceat(g[order], cut, axis=0), sorted_[cut].astype(np.int64) + base
        self.square[row] += np.einsum("ij,ij->i", move, move) / g.shape[1]
        self.w[row] -= (RATE / np.sqrt(self.square[row]))[:, None] * move
        self.met[row] += np.diff(np.append(cut, len(rows)))

    def moves(self, base: int):
        """(row from ``base``, times met, moves weighed by these), of CLASSES columns."""
        row = np.flatnonzero(self.met)
        delta = np.zeros((len(row), CLASSES), np.float32)
        delta[:, : self.w.shape[1]] = (self.w - self.start)[row] * self.met[row][:, None]
        for a in range(0, len(row), 4096):
            z = slice(a, a + 4096)
            yield row[z] + base, self.met[row[z]], delta[z]


def train_round(rows: DataFrame, start: tuple[np.ndarray, np.ndarray], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One pass over ``rows``: each task descends from ``start`` (class and cell weights) on its own rows, and the
    moves are averaged by weight row, each task counting as often as it met the row. The averaging is a grouped sum."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((start, table))
    names = [f"d{i}" for i in range(CLASSES)]

    def descend(batches):
        start, table = shared.value
        top, low = map(_Descent, start)
        for b in batches:
            for x in blocks(b.column(0)):
                f, y, previous, cell = x.features(), class_of(x.ending, table).astype(np.int64), x.previous(), cell_of(x.hash)
                for a in range(0, len(y), BATCH):
                    z = slice(a, a + BATCH)
                    part = tuple(k[z] for k in f)
                    g = probabilities(top.w, part)
                    g[np.arange(len(g)), y[z]] -= 1
                    for k, base in zip(part, BASES):
                        top.step(k, g, base)
                    top.step(np.zeros(1, np.uint16), g.sum(axis=0, keepdims=True), ROWS - 1)
                    top.met[-1] += len(g) - 1
                    inner = np.flatnonzero(y[z] > 0) + a
                    if len(inner):
                        own, kind = cell_rows(previous[inner], y[inner]), y[inner]
                        g = cell_probabilities(low.w, own, kind)
                        g[np.arange(len(g)), cell[inner]] -= 1
                        low.step(own, g)
                        low.step(kind.astype(np.uint16), g, CELL_SIZE)
        for half, base in ((top, 0), (low, ROWS)):
            for row, met, delta in half.moves(base):
                yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(met), *(pa.array(delta[:, i]) for i in range(CLASSES))], ["row", "met", *names])

    moved = rows.select("text").mapInArrow(descend, f"row int, met long, {', '.join(f'{n} float' for n in names)}")
    total = moved.groupBy("row").agg(F.sum("met").alias("met"), *[F.sum(n).alias(n) for n in names]).toArrow()  # ROWS + CELL_ROWS rows at most
    out = np.zeros((ROWS + CELL_ROWS, CLASSES), np.float32)
    if total.num_rows:
        row, met = total["row"].to_numpy(), total["met"].to_numpy()
        out[row] += np.stack([total[n].to_numpy() for n in names], axis=1).astype(np.float32) / met[:, None]
    shared.unpersist()
    return start[0] + out[:ROWS], start[1] + out[ROWS:, :CELLS]


class Model:
    """What was learnt: class and cell weights, class of each ending, word counts (a table), and the word factor's logarithms by class and cell."""

    def __init__(self, train: DataFrame):
        """Count the words of ``train`` (text, slot) and descend over all its rows, a seventh at first."""
        self.counts = counts = materialize(count_words(train), "word-counts")
        own = F.shiftrightunsigned("word", 9).bitwiseAND(F.lit(CELLS - 1).cast("long")).cast("int").alias("cell")
        per = counts.groupBy("ending", own).agg(F.sum("n").alias("n"), F.count("*").alias("v"), F.count_if(F.col("n") == 1).alias("once")).toArrow()  # 65,537 endings by CELLS at most
        ending, cell, n, v, once = (per[c].to_numpy().astype(np.int64) for c in ("ending", "cell", "n", "v", "once"))
        self.total, self.distinct = int(n.sum()), int(v.sum())
        self.table = _classes(np.bincount(ending[ending >= 0], n[ending >= 0], 65536))
        cls = class_of(ending, self.table).astype(np.int64)
        n_class = np.bincount(cls, n, CLASSES)
        n_cell, once_cell = (np.bincount(cls * CELLS + cell, x, CLASSES * CELLS) for x in (n, once))
        unseen = (once_cell + 0.5) / (n_cell + 1.0)
        unseen = np.where(n_cell > 0, np.minimum(unseen, 0.999), 1.0)
        self.log_unseen, self.log_seen = np.log10(unseen), np.log10(np.where(n_cell > 0, (1 - unseen) / np.maximum(n_cell, 1), 1.0))

        # the least count whose words and all more frequent ones are HEAD at most, on a logarithmic scale
        self.step = F.floor(F.log2("n") * 16)
        tiers = sorted(((r.step, r.v) for r in counts.groupBy(self.step.alias("step")).agg(F.count("*").alias("v")).collect()), reverse=True)
        self.least_step, held = 64 * 16, 0
        for s, k in tiers:
            if held + k > HEAD:
                break
            self.least_step, held = s, held + k
        head = counts.withColumn("step", self.step).where(F.col("step") >= self.least_step).select("word", "n").toArrow()
        words = head["word"].to_numpy().view(np.uint64)
        order = np.argsort(words)
        self.words, self.freq = words[order], head["n"].to_numpy()[order]

        weights = np.zeros((ROWS, CLASSES), np.float32), np.zeros((CELL_ROWS, CELLS), np.float32)
        weights[0][-1] = np.log(np.maximum(n_class, 0.5) / max(1, self.total))
        weights[1][CELL_SIZE:] = np.log(np.maximum(n_cell, 0.5).reshape(CLASSES, CELLS) / np.maximum(n_class, 1)[:, None])
        weights = train_round(train.where("slot = 0"), weights, self.table)
        self.weights, self.cell_weights = train_round(train.where("slot <> 0"), weights, self.table)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row.

    Texts are lower-cased by A-Z; a null or empty text is just its end token. With nothing to learn
    from, every token is unseen. score takes all unseen words of a class as one symbol, as base_score
    takes all unseen words. Repeated rows are learned from and scored as often as they occur; a null
    doc_id is learned from; extra columns are ignored; no rows give no rows.
    """
    rows = _rows(docs)
    return measured(rows, Model(rows.where("slot <> 2")))


def measured(rows: DataFrame, model: Model) -> DataFrame:
    """``score``'s columns of ``rows`` (doc_id, text, slot) by a model."""
    spark = rows.sparkSession
    counts, step, least_step, total, distinct = model.counts, model.step, model.least_step, model.total, model.distinct
    log_seen, log_unseen = model.log_seen, model.log_unseen
    shared = spark.sparkContext.broadcast((model.weights, model.cell_weights, model.table, model.words, model.freq, log_seen))

    def measure(batches):
        w, low, table, words, freq, log_seen = shared.value
        for b in batches:
            size = b.num_rows
            tokens, known, base, own = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros(size), np.zeros(size)
            tails = []
            for x in blocks(b.column(3)):
                y, cell = class_of(x.ending, table).astype(np.int64), cell_of(x.hash)
                chosen = np.empty(len(y))
                f, own_rows = x.features(), cell_rows(x.previous(), y)
                for a in range(0, len(y), BATCH):
                    z = slice(a, a + BATCH)
                    p = probabilities(w, tuple(k[z] for k in f))
                    q = cell_probabilities(low, own_rows[z], y[z])
                    at = np.arange(len(p))
                    chosen[z] = p[at, y[z]] * np.where(y[z] > 0, q[at, cell[z]], 1.0)
                y = y * CELLS + cell
                at = np.minimum(np.searchsorted(words, x.hash), max(0, len(words) - 1))
                hit = words[at] == x.hash if len(words) else np.zeros(len(y), bool)
                c = freq[at[hit]]
                tokens += np.bincount(x.row, minlength=size)
                known += np.bincount(x.row[hit], minlength=size)
                base += np.bincount(x.row[hit], np.log10(c + 1.0), size)
                own += np.bincount(x.row, np.log10(np.maximum(chosen, 1e-30)), size)
                own += np.bincount(x.row[hit], log_seen[y[hit]] + np.log10(c), size)
                tails.append((x.row[~hit], x.hash[~hit].view(np.int64), y[~hit]))
            row, word, cl = (np.concatenate(t) if tails else np.empty(0, np.int64) for t in zip(*tails))
            order = np.lexsort((word, row))
            row, word, cl = row[order], word[order], cl[order].astype(np.int32)
            cut = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (word[1:] != word[:-1])])) if len(row) else np.empty(0, np.int64)
            times = np.diff(np.append(cut, len(row))).astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row[cut], minlength=size))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(a)) for a in (word[cut], times, cl[cut].astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(tokens), pa.array(known), pa.array(base), pa.array(own), *lists],
                ["uid", "doc_id", "slot", "n_tokens", "known", "base", "own", "words", "times", "classes"],
            )

    schema = "uid long, doc_id long, slot int, n_tokens long, known long, base double, own double, words array<long>, times array<int>, classes array<int>"
    marked = rows.withColumn("uid", F.monotonically_increasing_id()).select("uid", "doc_id", "slot", "text")
    local = materialize(marked.mapInArrow(measure, schema), "local-scores")
    tail = local.select("uid", F.explode(F.arrays_zip("words", "times", "classes")).alias("x")).select("uid", "x.*")
    rare = counts.withColumn("step", step).where(F.col("step") < least_step).select(F.col("word").alias("words"), "n")
    seen_table, unseen_table = (F.array(*[F.lit(float(x)) for x in t]) for t in (log_seen, log_unseen))
    tail = tail.join(rare, "words", "left")
    word_score = F.when(F.col("n").isNull(), F.get(unseen_table, "classes")).otherwise(F.get(seen_table, "classes") + F.log10("n"))
    sums = tail.groupBy("uid").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("t_known"),
        F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0)).alias("t_base"),
        F.sum(F.col("times") * word_score).alias("t_own"),
    )
    joined = local.drop("words", "times", "classes").join(sums, "uid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        "doc_id",
        (F.col("slot") == 2).alias("held_out"),
        "n_tokens",
        (F.col("known") + zero("t_known")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + zero("t_base") - F.col("n_tokens") * float(np.log10(total + distinct + 1))).alias("base_score"),
        (F.col("own") + zero("t_own")).alias("score"),
    )
