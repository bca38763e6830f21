"""Quality classifier by importance resampling.

Two generative models over hashed n-grams (of bytes and of words) are counted: one on labelled good
texts (the target), one on all texts (raw). A document's log importance is the sum, over its n-grams,
of the log ratio of the two, by the square root of their number, with which the sum's own noise grows,
so that length does not decide; a temperature sets how far Gumbel noise reaches. That noise is added
and the k largest stay, which draws k documents without replacement in proportion to their importance;
k is the number of documents whose importance passes the level that best parts labelled documents that
the target model has not counted.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialize, own_names
from .maxent import word_hashes

#: Buckets of byte 3-grams, then those of word 2-grams.
GRAMS = 1 << 16
FEATURES, GRAM = 2 * GRAMS, 3
#: What log importances are multiplied by, against Gumbel noise of a standard deviation of 1.3.
TEMPERATURE = 2.0
#: At most this many labelled documents are used, half for the target model and half for the level.
LABELLED = 20_000
#: Bytes that are hashed at once.
BLOCK = 1 << 19
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _byte_grams(flat: np.ndarray) -> np.ndarray:
    """Bucket of the byte 3-gram that starts at each byte but the last two."""
    x = flat.astype(np.uint32)
    h = (x[:-2] | (x[1:-1] << np.uint32(8)) | (x[2:] << np.uint32(16))) * np.uint32(2654435761)
    return (h >> np.uint32(16)).astype(np.int64)


def _word_grams(hashes: np.ndarray) -> np.ndarray:
    """Bucket of each two words that follow one another."""
    h = (hashes[:-1] * np.uint64(0xA24BAED4963EE407) + hashes[1:]) * np.uint64(0x9FB21C651E98DF25)
    return GRAMS + (h >> np.uint64(48)).astype(np.int64)


def _short(held: list[tuple[int, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every n-gram of some texts, hashed as one block in which they stand apart."""
    flat = np.frombuffer(b" ".join(t for _, t in held), np.uint8)
    size = np.array([len(t) for _, t in held])
    end = np.cumsum(size + 1) - 1
    text = np.repeat(np.arange(len(held)), size + 1)[: len(flat)]
    rows = np.array([i for i, _ in held])
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    if len(flat) >= GRAM:
        inside = np.arange(2, len(flat)) < end[text[:-2]]
        found.append((rows[text[:-2][inside]], _byte_grams(flat)[inside]))
    starts, hashes, _ = word_hashes(flat)
    if len(starts) > 1:
        of = text[starts]
        same = of[1:] == of[:-1]
        found.append((rows[of[1:][same]], _word_grams(hashes)[same]))
    return np.concatenate([r for r, _ in found]), np.concatenate([c for _, c in found])


def _long(row: int, text: bytes):
    """The same of one text by blocks: 3-grams overlap, words are never cut and the last one is carried over."""
    flat = np.frombuffer(text, np.uint8)
    for a in range(0, len(flat) - GRAM + 1, BLOCK):
        codes = _byte_grams(flat[a : a + BLOCK + GRAM - 1])
        yield np.full(len(codes), row), codes
    a, last = 0, np.empty(0, np.uint64)
    while a < len(flat):
        z = a + BLOCK
        while z < len(flat) and not (blank := _BLANK[flat[z : z + BLOCK]]).any():
            z += BLOCK
        z = z + int(blank.argmax()) if z < len(flat) else len(flat)
        hashes = np.concatenate([last, word_hashes(flat[a:z])[1]])
        codes = _word_grams(hashes)
        yield np.full(len(codes), row), codes
        a, last = z, hashes[-1:]


def grams(column: pa.Array):
    """(row, bucket) arrays of all n-grams of a binary column, block by block; a null text is empty."""
    held, size = [], 0
    for i in range(len(column)):
        text = column[i].as_py() or b""
        if len(text) > BLOCK:
            yield from _long(i, text)
            continue
        held.append((i, text))
        size += len(text) + 1
        if size >= BLOCK:
            yield _short(held)
            held, size = [], 0
    if held:
        yield _short(held)


def ngram_counts(texts: DataFrame) -> DataFrame:
    """part, bucket, n: n-gram counts by model (``part`` 0 raw, 1 target), from rows (text binary, good boolean)."""

    def count(batches):
        n = np.zeros((2, FEATURES), np.int64)
        for b in batches:
            good = b.column(1).to_numpy(zero_copy_only=False)
            for row, code in grams(b.column(0)):
                n[0] += np.bincount(code, minlength=FEATURES)
                if (chosen := good[row]).any():
                    n[1] += np.bincount(code[chosen], minlength=FEATURES)
        part, bucket = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(bucket.astype(np.int32)), pa.array(n[part, bucket])], ["part", "bucket", "n"])

    partial = texts.mapInArrow(count, "part int, bucket int, n long")
    return partial.groupBy("part", "bucket").agg(F.sum("n").alias("n"))


def _labelled(labels: DataFrame, most: int) -> DataFrame:
    """A bounded sample of labelled doc_ids with their quality, half of them counted, the same at each run."""
    rows = own_names(labels, label_id=F.col("doc_id").cast("long"), quality=F.col("quality").cast("int")).where("label_id is not null and quality is not null")
    one = rows.groupBy("label_id").agg(F.min("quality").alias("quality"))
    few = one.orderBy(F.xxhash64("label_id"), "label_id").limit(most)
    return few.withColumn("counted", F.pmod(F.xxhash64(F.lit(1), "label_id"), F.lit(2)) == 0)


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target share by raw share of each bucket, half a count added to each."""
    share = lambda n: np.log((n + 0.5) / (n.sum() + 0.5 * len(n)))
    return share(target) - share(raw)


class QualityModel:
    """Log ratios of the hashed n-gram models, broadcast as FEATURES floats, and the level of those that stay."""

    def __init__(self, spark, ratios: np.ndarray, level: float | None = None):
        self.shared, self.level = spark.sparkContext.broadcast(ratios.astype(np.float32)), level

    def scored(self, docs: DataFrame) -> DataFrame:
        """``docs`` with __weight, the tempered log importance of its text (0 where it has no n-gram)."""
        shared = self.shared

        @F.arrow_udf("double")
        def weigh(texts: pa.Array) -> pa.Array:
            table, total, n = shared.value, np.zeros(len(texts)), np.zeros(len(texts))
            for row, code in grams(texts):
                total += np.bincount(row, table[code].astype(np.float64), len(texts))
                n += np.bincount(row, minlength=len(texts))
            return pa.array(TEMPERATURE * total / np.sqrt(np.maximum(n, 1)))

        return docs.withColumn("__weight", weigh(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> QualityModel:
    """Count both models and set the level.

    Raw counts are over all documents. With no good or no bad document among those that set the level
    there is nothing to part: every document passes.
    """
    spark = docs.sparkSession
    chosen = materialize(_labelled(labels, most), "labelled")
    rows = own_names(docs, doc_id=F.col("doc_id").cast("long"), text=F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    # ``most`` rows of 13 bytes at the most are broadcast
    marked = rows.join(F.broadcast(chosen), rows.doc_id == chosen.label_id, "left").select("text", F.coalesce((F.col("quality") == 1) & F.col("counted"), F.lit(False)).alias("good"))
    found = ngram_counts(marked).toArrow()  # two rows a feature at the most
    n = np.zeros((2, FEATURES))
    n[found["part"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    model = QualityModel(spark, log_ratios(n[0], n[1]) if n[1].sum() else np.zeros(FEATURES))
    known = rows.join(F.broadcast(chosen.where("not counted")), rows.doc_id == chosen.label_id).select("text", "quality")
    seen = model.scored(known).select("__weight", "quality").toArrow()  # bounded by ``most`` labelled documents
    w, good = seen["__weight"].to_numpy(), seen["quality"].to_numpy() == 1
    if good.any() and not good.all():
        model.level = _level(w, good)
    return model


def _level(weights: np.ndarray, good: np.ndarray, cost: float = 5.0) -> float:
    """The level with the fewest errors, a good document lost counting ``cost`` times; amid the gap that it falls in."""
    order = np.argsort(weights, kind="stable")
    w, g = weights[order], good[order]
    lost = np.concatenate([[0], np.cumsum(g)]) * cost + (~g).sum() - np.concatenate([[0], np.cumsum(~g)])
    i = int(np.argmin(lost))
    if i == 0:
        return float(w[0]) - 1.0
    if i == len(w):
        return float(w[-1]) + 1.0
    return float(w[i - 1] + w[i]) / 2


def gumbel(seed: int = 11):
    """Gumbel noise by a hash of seed, doc_id and text: the same at each run."""
    u = (F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.col("text")), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, k: int, bins: int = 4096) -> float:
    """The k-th largest ``key`` by counting in ever finer bins; ``bins`` rows reach the driver a round."""
    lo, hi, n = keys.agg(F.min("key"), F.max("key"), F.count("key")).first()
    if k >= n:
        return lo
    while lo < hi:
        bin_ = F.least(F.lit(bins - 1), F.floor((F.col("key") - lo) / (hi - lo) * bins))
        rows = keys.where(F.col("key").between(lo, hi)).groupBy(bin_.alias("b")).agg(F.count("*").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r.b):
            if k <= r.n:
                lo, hi = r.lo, r.hi
                break
            k -= r.n
    return lo


def classify(docs: DataFrame, labels: DataFrame, most: int = LABELLED, seed: int = 11) -> tuple[DataFrame, QualityModel, float]:
    """(doc_id, log_weight, gumbel_key, kept for every row; the model; the least key that stays).

    A null or empty text has log_weight 0. Documents tied with the last one that stays, stay too.
    """
    model = fit(docs, labels, most)
    rows = own_names(docs, doc_id=F.col("doc_id").cast("long"), text=F.coalesce(F.col("text"), F.lit("")))
    keyed = model.scored(rows).select("doc_id", F.col("__weight").alias("log_weight"), (F.col("__weight") + gumbel(seed)).alias("key"))
    keyed = materialize(keyed, "importance")
    k = keyed.where(F.col("log_weight") >= model.level).count() if model.level is not None else keyed.count()
    least = kth_largest(keyed, k) if k else float("inf")
    if least is None:  # no documents
        least = float("inf")
    return keyed.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), (F.col("key") >= least).alias("kept")), model, least


def keep_good(docs: DataFrame, labels: DataFrame, seed: int = 11) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns and whatever others they bring; no rows give no rows.

    A null or empty text has log importance 0 and stays where the level lets it; repeated rows share
    their fate; without labels every row stays.
    """
    _, model, least = classify(docs, labels, seed=seed)
    noise = gumbel(seed)
    bare = docs.withColumn("__text", F.col("text")).withColumn("text", F.coalesce(F.col("text"), F.lit("")))
    scored = model.scored(bare).withColumn("__key", F.col("__weight") + noise)
    cols = [F.col("__text").alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return scored.where(F.col("__key") >= least).select(*cols)
