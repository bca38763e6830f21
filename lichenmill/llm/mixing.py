"""Mixing sources to target weights by a low-discrepancy schedule.

Every source's documents are shuffled by a keyed digest, laid end to end and cut into blocks
of equally many words. Slot i of the schedule takes the golden-ratio point frac(i * phi); the
source whose stretch of the cumulative target weights holds that point fills the slot, and
the slot's rank among its source's slots names the block (and the epoch) it takes. Slots are the
order of the mix: in its first n slots each source has its share of n but for a few slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, own_names, word_count

#: 2**32 / golden ratio, odd; the fractional part of i * phi is (i * GOLDEN mod 2**32) / 2**32.
GOLDEN, UNIT, HALF = 2654435769, 4294967296, 65536
#: Buckets of a source's shuffled stream, least number of cells of the schedule's points, slots ranked by one window.
BUCKETS, CELLS, CHUNK = 4096, 4096, 65536


def sized(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, source, size in words, shuffle key and its bucket: all that mixing needs of the texts."""
    base = own_names(
        docs,
        doc_id=F.col("doc_id"),
        source=F.col("source"),
        size=word_count(F.col("text")),
        text_hash=F.xxhash64(F.col("text")),
        shuffle_key=F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))),
    )
    return base.withColumn("bucket", F.conv(F.substring("shuffle_key", 1, 3), 16, 10).cast("int") % BUCKETS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3) -> DataFrame:
    """One row a source: source_no, source_size, target.

    Sources by code point (null last) weigh ``weights`` in turn. A target stops at ``max_repeat``
    times the source's size, and the excess goes to the others by weight: the water level below is
    the fixed point of that resharing. The windows run over one row a source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("source_no", (F.row_number().over(by_name) - 1).cast("int"))
    table = F.array(*[F.lit(int(w)) for w in weights])
    per = per.withColumn("weight", F.get(table, F.col("source_no") % len(weights)).cast("double"))
    per = per.withColumn("cap", (F.col("source_size") * max_repeat).cast("double"))
    per = per.withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", "source_no")
    per = per.withColumn("total", F.sum("source_size").over(whole).cast("double"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    per = per.withColumn("level", (F.col("total") - before) / rest)
    free = F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "source_no", "level"))
    per = per.withColumn("water", F.min(free).over(whole)["level"])
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("water") * F.col("weight")))
    return per.select("source", "source_no", "source_size", target.alias("target"))


def _slots(block_words: int):
    """Slots that a source's target takes: all blocks of its whole epochs, then those of the rest."""
    target, size = F.floor("target"), F.greatest(F.col("source_size"), F.lit(1))
    epochs = F.floor(target / size)
    return (epochs * F.ceil(F.col("source_size") / block_words) + F.ceil((target - epochs * size) / block_words)).cast("long")


def point(slot: Column) -> Column:
    """frac(slot * phi) in 32 bits, with products that stay below 2**63: points come again after 2**32 slots."""
    low, high = F.pmod(slot, F.lit(HALF)), F.pmod(F.floor(slot / HALF), F.lit(HALF))
    return F.pmod(low * GOLDEN + F.pmod(high * GOLDEN, F.lit(HALF)) * HALF, F.lit(UNIT)) / UNIT


def schedule(targets: DataFrame, block_words: int) -> DataFrame:
    """source_no, slot_rank, slot: the golden-ratio schedule over as many slots as the targets fill.

    A source whose target is full leaves its further slots empty; the few ranks that the sequence's
    discrepancy left out are added in slots at the end.
    """
    spark = targets.sparkSession
    order = Window.orderBy("source_no")
    need = targets.withColumn("slots", _slots(block_words))
    n_slots, n_sources = need.agg(F.coalesce(F.sum("slots"), F.lit(0)), F.count("*")).first()
    cells_ = max(CELLS, 4 * n_sources)  # so that points meet less than two sources' cells on average
    whole = F.sum("target").over(Window.partitionBy())
    upto = F.sum("target").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    need = need.withColumn("hi", upto / whole).withColumn("lo", (upto - F.col("target")) / whole)
    need = need.where(F.col("slots") > 0).select("source_no", "slots", "lo", "hi")
    cells = need.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") * cells_), F.least(F.lit(cells_ - 1), F.floor(F.col("hi") * cells_)))))
    points = spark.range(n_slots).select(F.col("id").alias("slot"), point(F.col("id")).alias("x"))
    points = points.withColumn("cell", F.floor(F.col("x") * cells_).cast("long"))
    hit = points.join(cells.withColumn("cell", F.col("cell").cast("long")), "cell")
    hit = hit.where((F.col("x") >= F.col("lo")) & (F.col("x") < F.col("hi"))).select("source_no", "slot", "slots")
    hit = hit.withColumn("chunk", F.floor(F.col("slot") / CHUNK))
    # ranks by prefix sums over chunks, so that a source with most slots is not one task's window
    per_chunk = hit.groupBy("source_no", "chunk").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("source_no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    per_chunk = per_chunk.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    within = Window.partitionBy("source_no", "chunk").orderBy("slot")
    ranked = hit.join(per_chunk.select("source_no", "chunk", "base"), ["source_no", "chunk"])
    ranked = ranked.withColumn("slot_rank", F.col("base") + F.row_number().over(within) - 1)
    main = ranked.where(F.col("slot_rank") < F.col("slots")).select("source_no", "slot_rank", "slot")
    got = hit.groupBy("source_no").agg(F.count("*").alias("got"))
    left = need.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0)))
    left = left.where(F.col("got") < F.col("slots")).withColumn("missing", F.col("slots") - F.col("got"))
    left = left.withColumn("at", n_slots - F.col("got") + F.sum("missing").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("missing"))
    tail = left.select("source_no", "at", F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("slot_rank"))
    return main.unionByName(tail.select("source_no", "slot_rank", (F.col("at") + F.col("slot_rank")).alias("slot")))


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_repeat: int = 3, block_words: int = 4096, seed: str = "mix"
) -> DataFrame:
    """One row a document: doc_id, source, size, source_size, target, taken (words, repeats counted), first_slot, starts, text_hash.

    first_slot is the schedule's slot that the document's first words fill first (null where none are
    taken), starts that of each time it is taken, in order. Each source's taken words are its target
    rounded down. A null text has no words; a document of no words is taken 0 times; a null source is
    a source of its own; repeated rows count as documents of their own; no documents give no rows;
    extra columns are ignored.
    """
    sizes = materialize(sized(docs, seed), "mix-sizes")
    targets = materialize(source_targets(sizes, weights, max_repeat), "mix-targets")
    d, t = sizes.alias("d"), targets.alias("t")
    placed = d.join(t, F.col("d.source").eqNullSafe(F.col("t.source"))).select(
        "d.doc_id", "d.source", "d.size", "d.text_hash", "d.shuffle_key", "d.bucket", "t.source_no", "t.source_size", "t.target"
    )
    # each document's first word in its source's shuffled stream: prefix sums over buckets, then within one
    per_bucket = placed.groupBy("source_no", "bucket").agg(F.sum("size").alias("n"))
    ahead = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    per_bucket = per_bucket.withColumn("base", F.coalesce(F.sum("n").over(ahead), F.lit(0))).drop("n")
    within = Window.partitionBy("source_no", "bucket").orderBy("shuffle_key", "doc_id", "size", "text_hash")
    placed = placed.join(per_bucket, ["source_no", "bucket"])
    placed = placed.withColumn("row_no", F.row_number().over(within))
    placed = placed.withColumn("start", F.col("base") + F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    first, last = F.col("start"), F.greatest(F.col("start"), F.col("start") + F.col("size") - 1)
    pieces = placed.withColumn("block", F.explode(F.sequence(F.floor(first / block_words), F.floor(last / block_words))))
    lo = F.greatest(F.col("start"), F.col("block") * block_words)
    hi = F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block_words)
    pieces = pieces.withColumn("at", lo - F.col("block") * block_words).withColumn("words", hi - lo).withColumn("begins", lo == F.col("start"))

    slots = schedule(targets, block_words).join(targets.select("source_no", "source_size", "target"), "source_no")
    n_blocks = F.ceil(F.col("source_size") / block_words)
    slots = slots.withColumn("epoch", F.floor(F.col("slot_rank") / n_blocks)).withColumn("block", F.pmod("slot_rank", n_blocks))
    room = F.floor("target") - F.col("epoch") * F.col("source_size") - F.col("block") * block_words
    slots = slots.select("source_no", "slot", F.col("block").cast("long").alias("block"), F.greatest(F.lit(0), F.least(room, F.lit(block_words))).alias("room"))

    took = F.greatest(F.lit(0), F.least(F.col("words"), F.coalesce(F.col("room"), F.lit(0)) - F.col("at")))
    joined = pieces.withColumn("block", F.col("block").cast("long")).join(slots, ["source_no", "block"], "left").withColumn("took", took)
    key = ["source_no", "bucket", "row_no", "doc_id", "source", "size", "source_size", "target", "text_hash"]
    starts = F.array_sort(F.collect_list(F.when(F.col("begins") & (F.col("took") > 0), F.col("slot"))))  # max_repeat at the most
    out = joined.groupBy(*key).agg(F.coalesce(F.sum("took"), F.lit(0)).cast("long").alias("taken"), starts.alias("starts"))
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", F.get("starts", F.lit(0)).alias("first_slot"), "starts", "text_hash")


def take_texts(docs: DataFrame, mixed: DataFrame) -> DataFrame:
    """The mix itself in the order of the schedule: every document as often as it was taken whole, then its first words for the rest.

    ``docs`` has the columns of documents; so has the result. A document not taken (a null or wordless
    text never is) is absent; repeated rows are taken as often as all of them were; documents that
    begin in one slot follow by a hash. No documents give no rows.
    """
    key = lambda text: F.xxhash64(F.col("doc_id").cast("string"), text)
    d = docs.withColumn("__key", key(F.xxhash64("text"))).dropDuplicates(["__key"])
    m = mixed.where("taken > 0").groupBy(key(F.col("text_hash")).alias("__key")).agg(
        F.sum("taken").alias("__taken"), F.max("size").alias("__size"), F.array_sort(F.flatten(F.collect_list("starts"))).alias("__starts")
    )
    j = d.join(m, "__key")
    whole = F.floor(F.col("__taken") / F.col("__size")).cast("int")
    rest = (F.col("__taken") % F.col("__size")).cast("int")
    # bounded repetition counts allow one compiled pattern: words are cut by splitting with a limit
    parts = F.split(F.ltrim(F.translate("text", "\t\n\x0b\f\r", "     ")), " +")
    cut = F.array_join(F.slice(parts, F.lit(1), rest), " ")
    each = j.withColumn("__n", F.explode(F.sequence(F.lit(0), whole - F.when(rest > 0, 0).otherwise(1))))
    each = each.withColumn("__slot", F.coalesce(F.get("__starts", F.col("__n")), F.array_max("__starts")))
    each = each.withColumn("__each", F.when(F.col("__n") < whole, F.col("text")).otherwise(cut))
    cols = [F.col("__each").alias("text") if c == "text" else F.length("__each").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return each.select(*cols, "__slot", "__key").repartitionByRange("__slot", "__key").sortWithinPartitions("__slot", "__key").select(*docs.columns)
