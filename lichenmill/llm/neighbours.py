"""Approximate nearest neighbours: a graph by NN-descent in Spark joins, searched greedily.

Equal vectors are one node. The first graph comes from exact search within short stretches of a
few random-projection orders. Each round joins every node's neighbours (and those it is a
neighbour of) with their vectors, compares them with one another, and keeps each node's nearest.
A query walks the graph best first, many queries at a time, each with a small pool of its own, and
its pool is ranked by exact distances of the original vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize, own_names, release, runs

DEGREE, PASSES, STRETCH, ROUNDS = 48, 4, 512, 4
#: Nodes a query keeps, nodes it follows at each hop, and hops: it meets 2 * DEGREE * EXPAND * HOPS others at the most.
POOL, EXPAND, HOPS = 200, 20, 4
#: The projections' medians are fitted on this many vectors at most; every vector is indexed.
SAMPLE = 4096
#: Components beyond this many times the usual size are taken as that, in the graph alone.
FAR = 1e18


def valid_vectors(table: DataFrame) -> DataFrame:
    """vec_id, vector (doubles): rows without a null id, and whose vector is not null, empty or zero and has finite components only."""
    rows = own_names(table, vec_id=F.col("vec_id").cast("long"), vector=F.col("embedding").cast("array<double>")).where("vec_id is not null and vector is not null")
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(~F.coalesce(bad, F.lit(True)) & F.exists("vector", lambda x: x != 0))


def _matrix(column: pa.Array) -> np.ndarray:
    """Single-precision vectors of a binary column as a matrix of doubles."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float32).reshape(len(rows), -1).astype(np.float64)


def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


_LISTS = "node long, nbrs array<long>, dists array<float>, fresh array<boolean>"
_LIST_SCHEMA = pa.schema([("node", pa.int64()), ("nbrs", pa.list_(pa.int64())), ("dists", pa.list_(pa.float32())), ("fresh", pa.list_(pa.bool_()))])


def _lists(nodes: np.ndarray, sizes: np.ndarray, nbrs: np.ndarray, dists: np.ndarray, fresh: np.ndarray) -> pa.RecordBatch:
    """A row for each of ``nodes``, of so many entries each."""
    at = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    columns = (pa.array(nbrs), pa.array(dists.astype(np.float32)), pa.array(fresh))
    return pa.RecordBatch.from_arrays([pa.array(nodes), *(pa.ListArray.from_arrays(at, c) for c in columns)], schema=_LIST_SCHEMA)


def _flat(t: pa.Table) -> tuple[np.ndarray, ...]:
    """(node, nbr, dist, fresh) of every entry of a table of lists."""
    t = t.combine_chunks()
    lists = t.column("nbrs")
    sizes = pa.compute.list_value_length(lists).to_numpy()
    flat = (t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("nbrs", "dists", "fresh"))
    return np.repeat(t.column("node").to_numpy(), sizes), *flat


def _merge(cand: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` nearest of each node, nearest first, of lists (node, nbrs, dists, fresh); an entry met before is not fresh."""

    def top(tables):
        node, nbr, dist, fresh = _flat(pa.concat_tables(tables))
        order = np.lexsort((fresh, nbr, node))
        node, nbr, dist, fresh = (x[order] for x in (node, nbr, dist, fresh))
        one = np.concatenate([[True], (node[1:] != node[:-1]) | (nbr[1:] != nbr[:-1])]) if len(node) else np.empty(0, bool)
        node, nbr, dist, fresh = (x[one] for x in (node, nbr, dist, fresh))
        order = np.lexsort((nbr, dist, node))
        node, nbr, dist, fresh = (x[order] for x in (node, nbr, dist, fresh))
        cut = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]])) if len(node) else np.empty(0, np.int64)
        sizes = np.diff(np.append(cut, len(node)))
        keep = np.arange(len(node)) - np.repeat(cut, sizes) < degree
        return _lists(node[cut], np.minimum(sizes, degree), nbr[keep], dist[keep], fresh[keep])

    def merge(batches):
        held: list[pa.Table] = []
        for b in batches:
            if not b.num_rows:
                continue
            keys = b.column(0).to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            t = pa.Table.from_batches([b])
            if held and keys[0] != held[-1].column(0)[-1].as_py():
                yield top(held)
                held = []
            if last:
                yield top([*held, t.slice(0, last)])
                held = []
            held.append(t.slice(last))
            if len(held) > 1 and sum(h.num_rows for h in held) > 4096:  # a node that very many lists name
                held = [pa.Table.from_batches([top(held)])]
        if held:
            yield top(held)

    return cand.repartition("node").sortWithinPartitions("node").mapInArrow(merge, _LISTS)


def _stretches(nodes: DataFrame, dim: int, degree: int, passes: int) -> DataFrame:
    """Lists of each node's nearest within stretches of STRETCH nodes of some random orders."""
    sample = _matrix(nodes.orderBy(F.xxhash64("node")).limit(SAMPLE).select("point").toArrow().column("point").combine_chunks())
    rng = np.random.default_rng(5)
    planes = [rng.standard_normal((dim, 12)) for _ in range(passes)]
    shared = nodes.sparkSession.sparkContext.broadcast([(p, np.median(sample @ p, axis=0)) for p in planes])

    def order(batches):
        for b in batches:
            x = _matrix(b.column(1))
            for k, (plane, middle) in enumerate(shared.value):
                at = x @ plane - middle
                code = (at > 0) @ (1 << np.arange(at.shape[1])[::-1])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), k, np.int32)), pa.array(code.astype(np.int64)), pa.array(at[:, 0].astype(np.float64)), b.column(0), b.column(1)], ["pass", "code", "along", "node", "point"])

    def search(batches):
        for _, t in runs(batches, "pass"):
            for a in range(0, t.num_rows, STRETCH):
                part = t.slice(a, STRETCH)
                ids, x = part.column("node").to_numpy(), _matrix(part.column("point").combine_chunks())
                k = min(degree, len(ids) - 1)
                if k < 1:
                    continue
                d = _square(x, x)
                np.fill_diagonal(d, np.inf)
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                yield _lists(ids, np.full(len(ids), k), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel(), np.ones(near.size, bool))

    keyed = nodes.select("node", "point").mapInArrow(order, "pass int, code long, along double, node long, point binary")
    dealt = keyed.repartitionByRange("pass", "code", "along").sortWithinPartitions("pass", "code", "along", "node")
    return dealt.mapInArrow(search, _LISTS)


def _with_reverse(graph: DataFrame, degree: int) -> DataFrame:
    """node, nbr, fresh: every node's neighbours and the ``degree`` nearest of those that name it; a mutual one comes twice."""
    own = graph.select("node", F.explode(F.arrays_zip("nbrs", "dists", "fresh")).alias("x")).select("node", F.col("x.nbrs").alias("nbr"), F.col("x.dists").alias("dist"), F.col("x.fresh").alias("fresh"))
    order = Window.partitionBy("node").orderBy("dist", "nbr")
    back = own.select(F.col("nbr").alias("node"), F.col("node").alias("nbr"), "dist", "fresh")
    back = back.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= degree)
    return own.select("node", "nbr", "fresh").unionByName(back.select("node", "nbr", "fresh"))


def build_graph(nodes: DataFrame, dim: int, degree: int = DEGREE, rounds: int = ROUNDS, passes: int = PASSES) -> DataFrame:
    """node, nbrs, dists (squared, of scaled vectors, least first), fresh: the neighbour graph of ``nodes`` (node, point)."""
    graph = materialize(_merge(_stretches(nodes, dim, degree, passes), degree), "graph")

    def compare(batches):
        held, size = [], 0

        def flush():
            return _lists(*(np.concatenate(x) for x in zip(*held)))

        for _, t in runs(batches, "node"):
            ids, at, back = np.unique(t.column("nbr").to_numpy(), return_index=True, return_inverse=True)
            if len(ids) < 2:
                continue
            fresh = np.zeros(len(ids), bool)
            np.logical_or.at(fresh, back, t.column("fresh").to_numpy())
            reach = t.column("reach").to_numpy()[at]
            d = _square(x := _matrix(t.column("point").take(pa.array(at)).combine_chunks()), x)
            ok = (fresh[:, None] | fresh[None]) & (d < reach[:, None])
            np.fill_diagonal(ok, False)
            n = ok.sum(axis=1)
            some = np.flatnonzero(n)
            if len(some):
                j = np.nonzero(ok)[1]
                held.append((ids[some], n[some], ids[j], d[ok], np.ones(len(j), bool)))
                size += len(j)
                if size > 500_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    for _ in range(rounds):
        reach = F.when(F.size("dists") >= degree, F.array_max("dists")).otherwise(F.lit(float("inf"))).cast("float")
        known = nodes.select(F.col("node").alias("nbr"), "point").join(graph.select(F.col("node").alias("nbr"), reach.alias("reach")), "nbr", "left")
        pairs = _with_reverse(graph, degree).join(known, "nbr").select("node", "nbr", "fresh", "point", F.coalesce("reach", F.lit(float("inf"))).cast("float").alias("reach"))
        found = pairs.repartition("node").sortWithinPartitions("node").mapInArrow(compare, _LISTS)
        stale = graph.withColumn("fresh", F.transform("fresh", lambda x: F.lit(False)))
        graph = materialize(_merge(stale.unionByName(found), degree), "graph")
        release(nodes.sparkSession)
    return graph


def _advance(pool: int, expand: int):
    """Sorted rows of queries (their state, then the vectors met) to the queries' new states."""
    schema = pa.schema([("query", pa.int64()), ("own", pa.binary()), ("ids", pa.list_(pa.int64())), ("dists", pa.list_(pa.float64())), ("seen", pa.list_(pa.bool_())), ("next", pa.list_(pa.int64()))])

    def one(query, t):
        own, ids, dists, seen = (t.column(c)[0].as_py() for c in ("point", "ids", "dists", "seen"))
        ids, dists, seen = np.array(ids, np.int64), np.array(dists, np.float64), np.array(seen, bool)
        met = t.slice(1)
        if met.num_rows:
            new = met.column("nbr").to_numpy()
            x = _matrix(met.column("point").combine_chunks()) - np.frombuffer(own, np.float32).astype(np.float64)
            fresh = ~np.isin(new, ids) & (new != query)
            new, d = new[fresh], (x[fresh] ** 2).sum(1)
            ids, dists, seen = np.concatenate([ids, new]), np.concatenate([dists, d]), np.concatenate([seen, np.zeros(len(new), bool)])
        order = np.lexsort((ids, dists))[:pool]
        ids, dists, seen = ids[order], dists[order], seen[order]
        turn = np.flatnonzero(~seen)[:expand]
        seen[turn] = True
        return {"query": int(query), "own": own, "ids": ids, "dists": dists, "seen": seen, "next": ids[turn]}

    def advance(batches):
        got = []
        for query, t in runs(batches, "query"):
            got.append(one(query, t))
            if len(got) >= 500:
                yield pa.RecordBatch.from_pylist(got, schema)
                got = []
        if got:
            yield pa.RecordBatch.from_pylist(got, schema)

    return advance


def search_graph(graph: DataFrame, nodes: DataFrame, queries: DataFrame, degree: int = DEGREE, pool: int = POOL, expand: int = EXPAND, hops: int = HOPS) -> DataFrame:
    """query (a node), own, ids, dists, seen, next: the pool that a best-first walk from each of ``queries`` (query) has gathered, nearest first.

    A hop follows the ``expand`` nearest nodes of each pool that it has not followed yet; the vectors
    that it meets are joined by node, and come together with their query's state in one more shuffle.
    """
    spark = nodes.sparkSession
    links = _with_reverse(graph, degree).groupBy("node").agg(F.collect_set("nbr").alias("nbrs"))  # 2 * degree at the most
    links = materialize(links, "links")
    points = nodes.select(F.col("node").alias("nbr"), "point")
    state = queries.join(nodes, queries.query == nodes.node).select("query", "point").join(graph, F.col("query") == graph.node, "left")
    ids, dists = F.coalesce("nbrs", F.array().cast("array<long>")), F.coalesce(F.col("dists").cast("array<double>"), F.array().cast("array<double>"))
    state = state.select("query", F.col("point").alias("own"), ids.alias("ids"), dists.alias("dists"))
    state = state.withColumn("seen", F.transform("ids", lambda x, i: i < expand)).withColumn("next", F.slice("ids", 1, expand))
    kinds = "query long, own binary, ids array<long>, dists array<double>, seen array<boolean>, next array<long>"
    state = materialize(state, "walk")
    for _ in range(hops):
        steps = state.select("query", F.explode("next").alias("node")).join(links, "node").select("query", F.explode("nbrs").alias("nbr")).distinct()
        met = steps.join(points, "nbr").select("query", "nbr", "point")
        none = [F.lit(None).cast(k).alias(c) for c, k in (("ids", "array<long>"), ("dists", "array<double>"), ("seen", "array<boolean>"))]
        both = state.select("query", F.lit(None).cast("long").alias("nbr"), F.col("own").alias("point"), "ids", "dists", "seen").unionByName(met.select("query", "nbr", "point", *none))
        dealt = both.repartition("query").sortWithinPartitions("query", F.col("nbr").asc_nulls_first())
        state = materialize(dealt.mapInArrow(_advance(pool, expand), kinds), "walk")
        release(spark)
    return state


def nearest(table: DataFrame, every: int = 100, k: int = 10, pool: int = POOL) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row whose vec_id is divisible by ``every``.

    score is the Euclidean distance of the original vectors in double precision; ties go to the smaller
    vec_id. Vectors that ``valid_vectors`` leaves out take no part; nor do those of another length than
    most have (of lengths equally frequent, the longest), since no distance is defined to them. The
    graph holds vectors in single precision, measured by the median size. Of equal vectors the k + 1
    smallest ids are kept, which is all that a result can name. Of repeated vec_ids the least vector
    counts. No vectors give no rows; extra columns are ignored.
    """
    rows = materialize(valid_vectors(table).groupBy("vec_id").agg(F.min("vector").alias("vector")), "vectors")
    size = F.array_max(F.transform("vector", F.abs))
    common = rows.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n"), F.percentile_approx(size, 0.5, 1000).alias("usual")).orderBy(F.desc("n"), F.desc("dim")).first()
    if not common:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim, scale = common.dim, float(common.usual)
    rows = rows.where(F.size("vector") == dim)

    def shrink(batches):
        for b in batches:
            with np.errstate(over="ignore"):
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) / scale
            x = np.clip(x, -FAR, FAR).astype(np.float32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary())], ["node", "point"])

    distinct = materialize(rows.groupBy("vector").agg(F.min("vec_id").alias("node")).select("node", "vector"), "distinct-vectors")
    nodes = materialize(distinct.mapInArrow(shrink, "node long, point binary"), "nodes")
    same = Window.partitionBy("vector").orderBy("vec_id")
    few = rows.withColumn("rank", F.row_number().over(same)).where(F.col("rank") <= k + 1)
    members = materialize(few.join(distinct, "vector").select("node", "vec_id"), "members")
    asked = materialize(rows.where(F.col("vec_id") % every == 0).join(distinct, "vector").select("vec_id", "node"), "asked")
    queries = materialize(asked.select(F.col("node").alias("query")).distinct(), "queries")

    graph = build_graph(nodes, dim)
    found = search_graph(graph, nodes, queries, pool=pool)
    short = found.select("query", F.explode(F.concat(F.array("query"), F.slice("ids", 1, 4 * k))).alias("nbr"))
    a, z = distinct.select(F.col("node").alias("query"), F.col("vector").alias("a")), distinct.select(F.col("node").alias("nbr"), F.col("vector").alias("z"))
    exact = short.join(z, "nbr").join(a, "query")
    gap = F.aggregate(F.zip_with("a", "z", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    exact = exact.select("query", F.col("nbr").alias("node"), F.sqrt(gap).alias("score"))
    named = exact.join(members, "node").select("query", "vec_id", "score")
    # per distinct query vector k + 1 rows are enough: a query leaves out itself only
    top = Window.partitionBy("query").orderBy("score", "vec_id")
    named = named.withColumn("at", F.row_number().over(top)).where(F.col("at") <= k + 1).drop("at")
    each = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query")).join(named, "query").where("vec_id <> query_id")
    final = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return each.withColumn("rank", F.row_number().over(final)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
