"""SimHash near-duplicates by covering locality-sensitive hashing.

With radius r, every bit position gets a vector of r + 1 bits; table v (a non-zero vector) looks at
the positions whose vector has odd overlap with v. Any r positions leave some v orthogonal to them
all, so two fingerprints at distance r or less agree in what some table sees: no pair is missed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LOWER_BYTES, join_counted, materialize, own_names, runs
from .components import components

#: A bucket of more fingerprints than this is dealt out again by masks over all bits under another seed.
BUCKET = 20_000
_LANES = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """64-bit SimHash: a bit is 1 if over half of the shingles' XXH64 (repeats included) have it."""
    words = text.translate(LOWER_BYTES).split()
    n = len(words) - shingle + 1
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    if n <= 1:
        return h(b" ".join(words), seed)
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist()
    hashes = np.fromiter((h(joined[i:j], seed) for i, j in zip(starts, ends[shingle - 1 :].tolist())), np.uint64, n)
    lanes = hashes.view(np.uint8).reshape(n, 8)
    counts = np.concatenate([np.bincount(lanes[:, k], minlength=256) @ _LANES for k in range(8)])
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) of every row; null and wordless texts have 0."""
    rows = own_names(docs, doc_id=F.col("doc_id").cast("long"), text=F.coalesce(F.col("text"), F.lit("")).cast("binary"))

    def map_(batches):
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return rows.mapInArrow(map_, "doc_id long, fp long")


def covering_masks(radius: int, seed: int = 0) -> list[int]:
    """The 2**(radius + 1) - 1 masks, as signed longs."""
    size = 1 << (radius + 1)
    # every vector is given to as equally many positions as can be, in an order drawn by the seed
    vectors = np.random.default_rng(seed).permutation(np.arange(64) % size)
    out = []
    for v in range(1, size):
        mask = sum(1 << i for i, x in enumerate(vectors.tolist()) if bin(x & v).count("1") % 2)
        out.append(mask - (1 << 64) if mask >> 63 else mask)
    return out


def _forest(fps: np.ndarray, radius: int) -> tuple[list, list]:
    """Edges of a spanning forest of the graph that links fingerprints within ``radius``."""
    left, us, vs = fps, [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            u = todo.pop()
            near = np.bitwise_count(left ^ u) <= radius
            if near.any():
                hit = left[near]
                us.extend([u] * len(hit))
                vs.extend(hit.tolist())
                todo.extend(hit)
                left = left[~near]
    return us, vs


def _link(radius: int, most: int | None):
    """Sorted (bucket, fp) rows to edges (u, v, null) and, for buckets over ``most``, rows (null, fp, bucket) to deal again."""

    def rows(us, vs, again):
        signed = lambda x: np.asarray(x, np.uint64).view(np.int64)
        u, v = signed(us), signed(vs)
        a = np.asarray(again, np.int64).reshape(-1, 2)
        n, m = len(u), len(a)
        if n + m:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([u, np.zeros(m, np.int64)]), mask=np.arange(n + m) >= n),
                    pa.array(np.concatenate([v, a[:, 1]])),
                    pa.array(np.concatenate([np.zeros(n, np.int64), a[:, 0]]), mask=np.arange(n + m) < n),
                ],
                ["u", "v", "again"],
            )

    def link(batches):
        key_held, held, n_held = None, [], 0

        def flush():
            if n_held > 1 and held:
                fps = np.unique(np.concatenate(held)).view(np.uint64)
                if len(fps) > 1:
                    yield from rows(*_forest(fps, radius), [])

        for b in batches:
            keys, fps = b.column(0).to_numpy(), b.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            us: list = []
            vs: list = []
            for i, j in zip(cuts, cuts[1:]):
                if i == j:
                    continue
                if keys[i] != key_held:
                    yield from flush()
                    key_held, held, n_held = keys[i], [], 0
                elif most and n_held > most:  # an overfull bucket: its later rows go on as they come
                    yield from rows([], [], [(keys[i], x) for x in fps[i:j].tolist()])
                    continue
                if j < len(keys) and i > 0 and not held:  # a whole bucket in this batch
                    if j - i > 1:
                        x, y = _forest(np.unique(fps[i:j]).view(np.uint64), radius)
                        us += x
                        vs += y
                    key_held = None
                    continue
                held.append(fps[i:j].copy())
                n_held += j - i
                if most and n_held > most:
                    yield from rows([], [], [(keys[i], x) for x in np.concatenate(held).tolist()])
                    held = []
            yield from rows(us, vs, [])
        yield from flush()

    return link


def link_edges(fps: DataFrame, radius: int = 4, bucket: int = BUCKET, levels: int = 3) -> DataFrame:
    """u, v: edges that join every two of the distinct fingerprints ``fps`` (fp) that are linked, by one step or more.

    Within a bucket only a spanning forest of the links is emitted. An overfull bucket is dealt out by
    further masks; the last level takes buckets of any size.
    """
    todo = fps.select(F.lit(0).cast("long").alias("bucket"), "fp")
    edges = None
    for level in range(levels):
        masks = covering_masks(radius, seed=level)
        tables = F.array(*[F.struct(F.lit(i).alias("t"), F.lit(m).cast("long").alias("m")) for i, m in enumerate(masks)])
        spread = todo.withColumn("x", F.explode(tables))
        keyed = spread.select(F.xxhash64("bucket", F.col("x.t"), F.col("fp").bitwiseAND(F.col("x.m"))).alias("bucket"), "fp")
        dealt = keyed.repartition("bucket").sortWithinPartitions("bucket", "fp")
        most = bucket if level < levels - 1 else None
        found = materialize(dealt.mapInArrow(_link(radius, most), "u long, v long, again long"), "links")
        new = found.where("again is null").select("u", "v")
        edges = new if edges is None else edges.union(new)
        todo = found.where("again is not null").select(F.col("again").alias("bucket"), F.col("v").alias("fp"))
        if level < levels - 1 and todo.isEmpty():
            break
    return edges


def near_groups(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fp, fingerprint (hex), component_id of every row.

    component_id is the smallest doc_id that links of ``radius`` bits or fewer reach, itself included;
    wordless texts have fingerprint 0 and link like any other; null doc_ids count only where a
    component has no other; extra columns are ignored and no rows give no rows.
    """
    marked = materialize(fingerprints(docs, shingle), "fingerprints")
    per = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "distinct-fps")
    comp = components(link_edges(per.select("fp"), radius)).withColumnRenamed("node", "fp")
    linked = per.join(comp, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("low").alias("component_id"))
    whole = materialize(linked.select("fp", "n", "root").join(least, "root").select("fp", "n", "component_id"), "fp-components")
    total = per.agg(F.sum("n")).first()[0] or 0
    out = join_counted(marked, whole, "fp", "n", total)
    return out.select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """The rows of ``docs`` whose doc_id is their component's smallest, with their columns.

    Repeated rows stay together; rows without a doc_id stay where their component has no other; wordless
    and null texts are one component; no rows give no rows.
    """
    keep = near_groups(docs, shingle, radius).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(keep, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select(*docs.columns)


# --- near-duplicates by shingle similarity -----------------------------------------------------------
#
# Pairs meet in bands of two minimum hashes of their five-word shingles: one of similarity s shares a band
# with probability s**2, so that all bands miss it with MISSED at most. In a bucket, pairs whose minimum
# hashes agree often enough make families; in each family the texts' whole shingle sets decide. (Fingerprints
# could not propose them: at a similarity of 0.8 two of them differ in 9.7 of 64 bits on average, and covering
# masks of such a radius are millions.)

#: Largest probability that bands, or the count of equal minimum hashes, miss a pair at the line.
MISSED = 1e-10
#: Shingles of a family that one task holds; a larger family is dealt into blocks of about as many.
BLOCK_SHINGLES = 1 << 20


def band_count(similarity: float) -> int:
    return 1 if similarity >= 1 else math.ceil(math.log(MISSED) / math.log(1 - similarity**2))


def least_equal(hashes: int, similarity: float) -> int:
    """The largest count that a pair at the line reaches but for MISSED, of so many minimum hashes."""
    below, k = 0.0, 0
    while k < hashes and (below := below + math.comb(hashes, k) * similarity**k * (1 - similarity) ** (hashes - k)) <= MISSED:
        k += 1
    return k


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; a shorter text is one shingle."""
    words = text.translate(LOWER_BYTES).split()
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = (ends - size)[:n].tolist() or [0]
    stops = ends[shingle - 1 :].tolist() or [len(joined)]
    h = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(joined[i:j], 7) for i, j in zip(starts, stops)), np.uint64, n))


def minimum_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """The minima of ``n`` rearrangements of the hashes."""
    draw = np.random.default_rng(5).integers(0, 1 << 64, (2, n, 1), np.uint64)
    x = (hashes ^ draw[0]) * (draw[1] | np.uint64(1))
    x ^= x >> np.uint64(32)
    return (x * np.uint64(0x9E3779B97F4A7C15)).min(axis=1)


def _band_keys(least: np.ndarray) -> np.ndarray:
    x = (least[0::2] * np.uint64(0xD6E8FEB86659FD93)) ^ (least[1::2] + np.arange(len(least) // 2, dtype=np.uint64))
    x ^= x >> np.uint64(32)
    return (x * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _forest_pairs(marks: np.ndarray, nodes: np.ndarray, need: int) -> list[tuple[int, int]]:
    """Pairs of a spanning forest of the rows that have ``need`` or more equal marks."""
    out, left = [], np.arange(len(nodes))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            u = todo.pop()
            near = (marks[left] == marks[u]).sum(axis=1) >= need
            if near.any():
                hit = left[near]
                out += [(nodes[u], v) for v in nodes[hit].tolist()]
                todo += hit.tolist()
                left = left[~near]
    return out


def _propose(need: int, most: int | None, heads: bool = False):
    """Sorted (bucket, node, marks) rows to pairs (u, v).

    A bucket that goes on is held until it is whole, or over ``most`` rows: then its rows come out again
    (v null). With ``heads``, the first row of each tree comes out so.
    """

    def rows(pairs, again=()):
        u, v = (np.array([p[i] for p in pairs], np.int64) for i in (0, 1))
        if again:
            nodes, keys, marks = (np.concatenate(x) for x in zip(*again))
            kinds = pa.array([*[None] * len(u), *(m.tobytes() for m in marks)], pa.binary())
            columns = [np.concatenate([u, nodes]), np.concatenate([v, np.zeros(len(nodes), np.int64)]), np.concatenate([np.zeros(len(u), np.int64), keys])]
        else:
            columns, kinds = [u, v, np.zeros(len(u), np.int64)], pa.nulls(len(u), pa.binary())
        blank = np.arange(len(columns[0])) >= len(u)
        return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1], mask=blank), pa.array(columns[2], mask=~blank), kinds], ["u", "v", "bucket", "marks"])

    def pairs_of(parts):
        keys, origin, nodes, marks = (np.concatenate(x) for x in zip(*parts))
        cuts = np.flatnonzero(np.diff(keys, prepend=~keys[0], append=~keys[-1]))
        pairs, tops = [], []
        for i, j in zip(cuts.tolist(), cuts[1:].tolist()):
            mine = _forest_pairs(marks[i:j], nodes[i:j], need) if j - i > 1 else []
            pairs += mine
            if heads:
                top = ~np.isin(nodes[i:j], [v for _, v in mine])
                tops.append((nodes[i:j][top], origin[i:j][top], marks[i:j][top]))
        pairs = sorted({(min(p), max(p)) for p in pairs})
        if pairs or tops:
            yield rows(pairs, tops)

    def propose(batches):
        held, n_held, over = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            keys, origin, nodes = (b.column(i).to_numpy() for i in range(3))
            marks = np.frombuffer(b"".join(b.column(3).to_pylist()), np.uint8).reshape(len(keys), -1)
            part = (keys, origin, nodes, marks)
            if over is not None:  # the rest of an overfull bucket goes on as it comes
                at = int(np.searchsorted(keys, over, "right"))
                if at:
                    yield rows([], [(nodes[:at], origin[:at], marks[:at])])
                part = tuple(x[at:] for x in part)
                if not len(part[0]):
                    continue
                over = None
            last = int(np.searchsorted(part[0], part[0][-1]))
            if held and part[0][0] != held[0][0][-1]:
                yield from pairs_of(held)
                held, n_held = [], 0
            if last:
                yield from pairs_of([*held, tuple(x[:last] for x in part)])
                held, n_held = [], 0
            held.append(tuple(x[last:].copy() for x in part))
            n_held += len(part[0]) - last
            if most and n_held > most:
                yield rows([], [(h[2], h[1], h[3]) for h in held])
                held, n_held, over = [], 0, part[0][-1]
        if held:
            yield from pairs_of(held)

    return propose


def _proposals(dealt: DataFrame, need: int, most: int, levels: int = 3) -> DataFrame:
    """u, v: pairs that join the rows of each bucket of ``dealt`` (bucket, node, marks) that have ``need`` equal marks, by one step or more.

    An overfull bucket is dealt into parts, whose trees' first rows then stand for them in the bucket.
    Parts are drawn anew in each bucket, so that two rows which share buckets meet in some part or by
    their trees; the last level takes what is left of a bucket whole.
    """
    schema = "u long, v long, bucket long, marks binary"
    pick = lambda df, key: df.select(key.alias("key"), "bucket", "node", "marks").repartition("key").sortWithinPartitions("key", "node")
    edges, todo = None, dealt
    for level in range(levels):
        found = materialize(pick(todo, F.col("bucket")).mapInArrow(_propose(need, most if level < levels - 1 else None), schema), "proposals")
        edges = found.where("v is not null") if edges is None else edges.unionByName(found.where("v is not null"))
        again = found.where("v is null").select("bucket", F.col("u").alias("node"), "marks")
        if level == levels - 1 or again.isEmpty():
            break
        parts = again.groupBy("bucket").agg(F.ceil(2 * F.count("*") / most).cast("long").alias("parts"))
        keyed = again.join(parts, "bucket")
        part = F.xxhash64("bucket", F.lit(level), F.pmod(F.xxhash64("bucket", "node"), F.col("parts")))
        found = materialize(pick(keyed, part).mapInArrow(_propose(need, None, heads=True), schema), "part-proposals")
        edges = edges.unionByName(found.where("v is not null"))
        todo = found.where("v is null").select("bucket", F.col("u").alias("node"), "marks")
    return edges.select("u", "v")


def group_sets(sets: list[np.ndarray], similarity: float) -> list[int]:
    """For each set of hashes the first set that links of ``similarity`` or more lead to."""
    size = np.array([len(x) for x in sets])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    parts = np.split(ids, np.cumsum(size)[:-1])
    root, mark = list(range(len(sets))), np.zeros(int(ids.max()) + 1, bool)
    left = np.arange(len(sets))
    flat, starts = ids, np.cumsum(size) - size
    while len(left) > 1:
        first, todo = int(left[0]), [int(left[0])]
        keep = np.arange(len(left)) > 0
        while True:
            if not keep.all():  # only what is left is looked at again
                flat, left = flat[np.repeat(keep, size[left])], left[keep]
                starts = np.cumsum(size[left]) - size[left]
            if not todo or not len(left):
                break
            u = todo.pop()
            mark[parts[u]] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            mark[parts[u]] = False
            keep = both / (size[u] + size[left] - both) < similarity
            hit = left[~keep].tolist()
            todo += hit
            for v in hit:
                root[v] = first
    return root


def cross_links(mine: list[np.ndarray], labels: np.ndarray, others: list[np.ndarray], other_labels: np.ndarray, similarity: float) -> set[tuple[int, int]]:
    """Pairs of different labels between which two sets of hashes are similar."""
    size = np.array([len(x) for x in others])
    starts = np.cumsum(size) - size
    words, flat = np.unique(np.concatenate(others), return_inverse=True)
    mark, links = np.zeros(len(words), bool), set()
    for x, label in zip(mine, labels.tolist()):
        at = np.searchsorted(words, x)
        at = at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == x)]
        mark[at] = True
        both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
        mark[at] = False
        hit = (both / (len(x) + size - both) >= similarity) & (other_labels != label)
        links |= {(label, v) for v in other_labels[hit].tolist()}
    return links


def _arrays(column) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint64) for x in column]


def _sets(rows: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """family, blocks, node, shingles of the rows (node, text) that ``members`` (node, family, blocks) names."""

    def sets(batches):
        for b in batches:
            found = [shingle_set(t.as_py(), shingle).tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(found, pa.binary())], ["family", "blocks", "node", "shingles"])

    texts = rows.select("node", "text").join(members, "node").dropDuplicates(["node"])
    return texts.select("family", "blocks", "node", "text").mapInArrow(sets, "family long, blocks long, node long, shingles binary")


def _grouped(sets: DataFrame, seed: int, similarity: float) -> DataFrame:
    """node, root: groups within each block of each family; a block is held by one task."""

    def grow(batches):
        for _, t in runs(batches, "cell"):
            nodes = t.column("node").to_numpy()
            root = group_sets(_arrays(t.column("shingles")), similarity)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])

    cell = F.xxhash64("family", F.pmod(F.xxhash64(F.lit(seed), "node"), F.col("blocks")))
    dealt = sets.select(cell.alias("cell"), "node", "shingles").repartition("cell").sortWithinPartitions("cell", "node")
    return dealt.mapInArrow(grow, "node long, root long")


def _blocks(weight: Column) -> Column:
    return F.ceil(weight / BLOCK_SHINGLES).cast("long")


def _large_groups(sets: DataFrame, similarity: float) -> DataFrame:
    """node, root in families too large for a task: ``sets`` (family, blocks, node, shingles).

    Groups are found within blocks, then among the first members of these. Where a family is more than
    one group after that, every member outside its largest group is compared, block by block, with all
    members of other groups: nothing that is linked is missed, and no task holds more than two blocks.
    """
    first = materialize(_grouped(sets, 1, similarity), "block-groups")
    heads = sets.join(first.where("node = root").select("node"), "node").withColumn("n", (F.length("shingles") / 8).cast("long"))
    fewer = heads.groupBy("family").agg(_blocks(F.sum("n")).alias("fewer"))
    heads = heads.join(fewer, "family").select("family", F.col("fewer").alias("blocks"), "node", "shingles")
    second = materialize(_grouped(heads, 2, similarity), "head-groups").toDF("head", "label")
    labels = first.join(second, F.col("root") == F.col("head")).select("node", "label")
    members = materialize(sets.join(labels, "node").select("family", "node", "label", "shingles", (F.length("shingles") / 8).cast("long").alias("n")), "labelled-sets")
    groups = members.groupBy("family", "label").agg(F.sum("n").alias("n"))
    per = groups.groupBy("family").agg(F.max_by("label", F.struct("n", "label")).alias("largest"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("rest"))
    open_ = per.where("rest > 0").select("family", "largest", _blocks(F.col("rest")).alias("a"), _blocks(F.col("all")).alias("b"))
    found = members.join(open_, "family")
    place = lambda seed, n: F.pmod(F.xxhash64(F.lit(seed), "node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = found.where("label <> largest").select("family", "label", "shingles", F.lit(True).alias("mine"), place(3, "a").alias("i"), every("b").alias("j"))
    others = found.select("family", "label", "shingles", F.lit(False).alias("mine"), place(4, "b").alias("j"), every("a").alias("i"))
    cells = mine.unionByName(others).select(F.xxhash64("family", "i", "j").alias("cell"), "mine", "label", "shingles")

    def link(batches):
        for _, t in runs(batches, "cell"):
            side = t.column("mine").to_numpy()
            if side.all() or not side.any():
                continue
            sets, label = _arrays(t.column("shingles")), t.column("label").to_numpy()
            a, b = np.flatnonzero(side).tolist(), np.flatnonzero(~side).tolist()
            pairs = cross_links([sets[i] for i in a], label[a], [sets[i] for i in b], label[b], similarity)
            if pairs:
                u, v = zip(*sorted(pairs))
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    links = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(link, "u long, v long")
    joined = components(links).withColumnRenamed("node", "label")
    return members.select("node", "label").join(joined, "label", "left").select("node", F.coalesce("root", "label").alias("root"))


def _whole_groups(rows: DataFrame, families: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """node, root: groups by whole shingle sets within ``families`` (node, root, n: the node's shingles), which no similar pair crosses."""
    weight = families.groupBy("root").agg(_blocks(F.sum("n")).alias("blocks"))
    members = materialize(families.join(weight, "root").select("node", F.col("root").alias("family"), "blocks"), "families")
    small = materialize(_grouped(_sets(rows, members.where("blocks <= 1"), shingle), 0, similarity), "near-groups")
    large = members.where("blocks > 1")
    if large.isEmpty():
        return small
    sets = materialize(_sets(rows, large, shingle), "family-sets")
    return small.unionByName(materialize(_large_groups(sets, similarity), "large-groups"))


def _fingerprint_links(marked: DataFrame, radius: int) -> DataFrame:
    """u, v: each node of ``marked`` (node, fp) with the smallest node that its fingerprint is linked to."""
    per = materialize(marked.groupBy("fp").agg(F.min("node").alias("low"), F.count("*").alias("n")), "distinct-fps")
    linked = per.join(components(link_edges(per.select("fp"), radius)).withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("low").alias("v"), F.sum("n").alias("all"))
    whole = materialize(linked.join(least, "root").where("all > 1").select("fp", "n", "v"), "fp-links")
    total = per.agg(F.sum("n")).first()[0] or 0
    return join_counted(marked.select("node", "fp"), whole, "fp", "n", total).where("node <> v").select(F.col("node").alias("u"), "v")


def similar_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """node, doc_id, component_id, kept: near-duplicates by the Jaccard similarity of word shingles.

    node is a hash of doc_id and text, so repeated rows are one document. Pairs that share a band of
    minimum hashes are proposed and then verified on whole texts. With ``radius``, texts whose
    fingerprints (``near_groups``) differ in as many bits or fewer are linked as well, and a group is
    whatever links of both kinds lead to. component_id is the smallest doc_id of
    the group, and the document that has it is kept (of several, one); a null doc_id stays only where a
    group has no other. A null text is empty; texts of fewer words than a shingle are one shingle, so
    they are similar if they have the same words, none included. No rows give no rows; extra columns are
    ignored.
    """
    rows = docs.select(node_id().alias("node"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text"))
    n = 2 * band_count(similarity)

    def mark(batches):
        for b in batches:
            found = [shingle_set(t.as_py(), shingle) for t in b.column(2)]
            least = np.array([minimum_hashes(x, n) for x in found], np.uint64).reshape(-1, n)
            keys = [_band_keys(x) for x in least]
            marks = [x.tobytes() for x in (least >> np.uint64(20)).astype(np.uint8)]
            fps = np.fromiter((fingerprint(t.as_py()) if radius is not None else 0 for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(marks, pa.binary()), pa.array([len(x) for x in found], pa.int64()), pa.array(fps.view(np.int64))], ["node", "doc_id", "buckets", "marks", "n", "fp"])

    marked = materialize(rows.mapInArrow(mark, "node long, doc_id long, buckets array<long>, marks binary, n long, fp long").dropDuplicates(["node"]), "minimum-hashes")
    dealt = marked.select(F.explode("buckets").alias("bucket"), "node", "marks")
    edges = _proposals(dealt, least_equal(n, similarity), BUCKET)
    families = components(edges).join(marked.select("node", "n"), "node")
    groups = _whole_groups(rows, families, shingle, similarity)
    if radius is not None:
        links = groups.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v"))
        groups = components(_fingerprint_links(marked, radius).unionByName(links))
    linked = marked.select("node", "doc_id").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = linked.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"))
    return linked.join(best, "root").select("node", "doc_id", F.col("best.doc_id").alias("component_id"), (F.col("node") == F.col("best.node")).alias("kept"))


def node_id():
    return F.xxhash64(F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit("")))


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """The rows of ``docs`` that ``similar_groups`` keeps, with their columns."""
    drop = similar_groups(docs, shingle, similarity, radius).where("NOT kept").select(F.col("node").alias("__node"))
    return docs.withColumn("__key", node_id()).join(drop, F.col("__key") == F.col("__node"), "left_anti").select(*docs.columns)
