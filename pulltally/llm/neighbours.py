"""Approximate nearest neighbours: an NN-descent graph, built and searched by Spark joins.

1. Equal vectors count once. Each vector gets a byte form (one scale per vector), which all steps but the last use.
2. Start: random hyperplanes, at the medians of a bounded sample, deal the vectors into cells of about LEAF; within a
   cell each vector gets its nearest few. TREES such deals give the first neighbour lists.
3. Descent: a vector's neighbourhood is its list and those that list it (the nearest REVERSE of them). Each round joins the
   neighbourhoods' vectors to their centres; in each neighbourhood every pair with a new member is measured, and pairs
   nearer than a member's farthest neighbour go to that member. Rounds end when few lists change.
4. Search: from a query's own node, the nearest EF found so far are expanded round by round, by a join with the
   neighbourhoods, until all of them have been. The final ranking uses the original vectors in double precision.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulltally.llm.scratch import Scratch

NEIGHBOURS = 32
REVERSE = 24
TREES = 6
LEAF = 1024
#: Nearest ones that a vector gets from each cell, and from each neighbourhood in a round.
FROM_CELL = 16
FROM_NEIGHBOURHOOD = 6
ROUNDS = 6
#: Rounds end when fewer than this share of all list entries changed.
FEW_CHANGES = 0.02
EF = 160
#: Vectors that the hyperplanes' medians are taken from.
SAMPLE = 4096
#: Rows up to this number are broadcast (vectors of some 100 bytes); more are joined by a shuffle.
BROADCAST_ROWS = 400_000


def usable(vector: Column) -> Column:
    """Not null, without null, infinite or undefined components, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _bytes(vectors: np.ndarray) -> list[bytes]:
    """Per vector: its scale (float32), then its components as signed bytes."""
    scale = (np.abs(vectors).max(axis=1) / 127).astype(np.float32)
    scale[scale == 0] = 1e-38
    whole = np.rint(vectors / scale[:, None]).clip(-127, 127).astype(np.int8)
    return [s.tobytes() + w.tobytes() for s, w in zip(scale, whole, strict=True)]


def _floats(column: pa.Array) -> np.ndarray:
    """The vectors of a column in byte form, all of one length."""
    if not len(column):
        return np.zeros((0, 1), np.float32)
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
    scale = np.ascontiguousarray(raw[:, :4]).view(np.float32)
    return raw[:, 4:].view(np.int8).astype(np.float32) * scale


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = -2 * (a @ b.T)
    out += (a * a).sum(axis=1)[:, None]
    out += (b * b).sum(axis=1)[None, :]
    return np.maximum(out, 0, out=out)


def _nearest(distance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of up to `most` smallest finite entries of each row."""
    most = min(most, distance.shape[1])
    at = np.argpartition(distance, most - 1, axis=1)[:, :most]
    rows = np.repeat(np.arange(len(distance)), most)
    cols = at.ravel()
    fine = np.isfinite(distance[rows, cols])
    return rows[fine], cols[fine]


def _rows(columns: list[np.ndarray], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)


def _coder(planes: np.ndarray, medians: np.ndarray):
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, bits, _ = planes.shape
        for batch in batches:
            vectors = _floats(batch.column("vector"))
            for tree in range(trees if len(vectors) else 0):
                above = (vectors @ planes[tree].T > medians[tree]) if bits else np.zeros((len(vectors), 0))
                cell = above @ (1 << np.arange(bits, dtype=np.int64)) if bits else np.zeros(len(vectors), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vectors), tree)), pa.array(cell.astype(np.int64)), batch.column("id"), batch.column("vector")], ["tree", "cell", "id", "vector"])

    return code


def _cells(group: pa.Table) -> pa.Table:
    """Each vector's nearest ones within a cell."""
    ids, vectors = group.column("id").to_numpy(), _floats(group.column("vector").combine_chunks())
    out = []
    for first in range(0, len(ids), 512):
        distance = _squared(vectors[first:first + 512], vectors)
        distance[np.arange(len(distance)), first + np.arange(len(distance))] = np.inf
        r, c = _nearest(distance, FROM_CELL)
        out.append((ids[first + r], ids[c], distance[r, c]))
    u, v, d = (np.concatenate(x) for x in zip(*out, strict=True))
    return pa.table({"u": u, "v": v, "d": d})


def _merged(edges: DataFrame) -> DataFrame:
    """(u, v, d, fresh): each node's nearest NEIGHBOURS. An edge that was there before isn't fresh."""
    edges = edges.repartition("u").groupBy("u", "v").agg(F.min("d").alias("d"), F.min("fresh").alias("fresh"))
    nearest = Window.partitionBy("u").orderBy("d", "v")
    return edges.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= NEIGHBOURS).drop("n")


def _neighbourhoods(edges: DataFrame, vectors: DataFrame, small: bool) -> DataFrame:
    """(center, members): those that a node lists and the nearest that list it, at most NEIGHBOURS + REVERSE.

    A member has its id, vector, the distance of its farthest neighbour, and whether its edge is fresh.
    """
    side = F.broadcast if small else lambda df: df
    farthest = edges.groupBy("u").agg(F.max("d").alias("far"), F.count("*").alias("n"))
    known = vectors.join(farthest, vectors["id"] == farthest["u"], "left").select("id", "vector", F.when(F.col("n") >= NEIGHBOURS, F.col("far")).otherwise(float("inf")).cast("float").alias("far"))
    back = edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "d", "fresh")
    nearest = Window.partitionBy("u").orderBy("d", "v")
    back = back.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= REVERSE).drop("n")
    both = edges.select("u", "v", "d", "fresh").union(back).select("u", "v", "fresh")
    member = F.struct(F.col("v").alias("id"), "vector", "far", "fresh")
    return both.join(side(known), F.col("v") == F.col("id")).groupBy(F.col("u").alias("center")).agg(F.collect_list(member).alias("members"))


def _local_join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v, d) of pairs within neighbourhoods that are nearer than u's farthest neighbour."""
    for batch in batches:
        lists = batch.column("members")
        flat = lists.flatten()
        bounds = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))])
        ids, far = flat.field("id").to_numpy(), flat.field("far").to_numpy()
        fresh, vectors = flat.field("fresh").to_numpy(zero_copy_only=False), _floats(flat.field("vector"))
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if fresh[a:b].any():
                distance = _squared(vectors[a:b], vectors[a:b])
                drop = ids[a:b, None] == ids[None, a:b]
                drop |= ~(fresh[a:b, None] | fresh[None, a:b])
                drop |= distance >= far[a:b, None]
                distance[drop] = np.inf
                r, c = _nearest(distance, FROM_NEIGHBOURHOOD)
                out.append((ids[a + r], ids[a + c], distance[r, c]))
        yield _rows([np.concatenate(x) for x in zip(*out, strict=True)], ["u", "v", "d"])


def neighbour_graph(vectors: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v, d, fresh): the nearest neighbours found of every row of vectors (id, vector in byte form), by NN-descent."""
    n = vectors.count()
    small = n <= BROADCAST_ROWS
    # About twice the sample passes the first filter, so that no task hands on much more than its share.
    order = F.shiftrightunsigned(F.xxhash64("id"), 2)
    drawn = vectors.where(order < min(2**62, 2**63 * SAMPLE // max(n, 1))).orderBy(order, "id").limit(SAMPLE)
    sample = _floats(pa.array([r["vector"] for r in drawn.collect()], pa.binary()))
    bits = max(0, int(np.ceil(np.log2(max(n, 1) / LEAF))))
    planes = np.random.default_rng(5).standard_normal((TREES if bits else 1, bits, sample.shape[1])).astype(np.float32)
    medians = np.median(np.einsum("sd,tbd->tbs", sample, planes), axis=2) if len(sample) else np.zeros(planes.shape[:2])
    dealt = scratch.save(vectors.mapInArrow(_coder(planes, medians), "tree long, cell long, id long, vector binary"), "dealt")
    # Cells that came out too large are dealt on by a hash.
    sizes = dealt.groupBy("tree", "cell").agg(F.ceil(F.count("*") / (2 * LEAF)).alias("parts"))
    dealt = dealt.join(sizes, ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "tree"), "parts"))
    first = dealt.groupBy("tree", "cell", "part").applyInArrow(_cells, "u long, v long, d float")
    edges = scratch.save(_merged(first.withColumn("fresh", F.lit(True))), "graph-0")
    for step in range(1, ROUNDS + 1):
        near = _neighbourhoods(edges, vectors, small)
        found = near.mapInArrow(_local_join, "u long, v long, d float").withColumn("fresh", F.lit(True))
        edges = scratch.save(_merged(edges.withColumn("fresh", F.lit(False)).union(found)), f"graph-{step}")
        if edges.where("fresh").count() <= FEW_CHANGES * n * NEIGHBOURS:
            break
    return edges


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances from queries to the members of the neighbourhoods that they expand."""
    for batch in batches:
        lists = batch.column("members")
        flat, lengths = lists.flatten(), lists.value_lengths().to_numpy(zero_copy_only=False)
        queries, vectors = _floats(batch.column("query_vector")), _floats(flat.field("vector"))
        if not len(vectors):
            continue
        owner = np.repeat(np.arange(len(lengths)), lengths)
        d = ((vectors - queries[owner]) ** 2).sum(axis=1)
        yield _rows([batch.column("query").to_numpy()[owner], flat.field("id").to_numpy(), d.astype(np.float32)], ["query", "id", "d"])


def search(queries: DataFrame, neighbourhoods: DataFrame, scratch: Scratch, ef: int = EF) -> DataFrame:
    """(query, id, d): up to ef nearest found for each query (query, start, query_vector), by greedy rounds from node `start`."""
    found = queries.select("query", F.col("start").alias("id"), F.lit(0.0).cast("float").alias("d"), F.lit(False).alias("expanded"))
    nearest = Window.partitionBy("query").orderBy("d", "id")
    for step in itertools.count():  # ends, as what has left a query's nearest ef stays out
        frontier = scratch.save(found.where("not expanded").join(queries.select("query", "query_vector"), "query").select("query", "id", "query_vector"), f"frontier-{step}")
        n = frontier.count()
        if not n:
            break
        side = F.broadcast(frontier) if n <= BROADCAST_ROWS else frontier
        met = neighbourhoods.join(side, F.col("center") == F.col("id")).select("query", "query_vector", "members")
        met = met.mapInArrow(_measure, "query long, id long, d float").withColumn("expanded", F.lit(False))
        both = found.withColumn("expanded", F.lit(True)).unionByName(met).groupBy("query", "id").agg(F.min("d").alias("d"), F.max("expanded").alias("expanded"))
        found = scratch.save(both.withColumn("n", F.row_number().over(nearest)).where(F.col("n") <= ef).drop("n"), f"found-{step}")
    return found.select("query", "id", "d")


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_bytes(flat.reshape(batch.num_rows, -1)), pa.binary())], ["id", "vector"])


def nearest_neighbours(table: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest rows found for the rows of `table` (vec_id, embedding) with is_query.

    Candidates are all rows but the query's own; nearness is Euclidean distance in double precision, ties go to the
    smaller vec_id. A query with fewer candidates gets them all. Rows without vec_id, and vectors that are null or
    zero or hold a null or non-finite component take no part, nor do those of another length than most have. Rows that
    repeat a vec_id with an equal vector count once; with different vectors the smallest counts.
    """
    spark = table.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = table.withColumn("is_query", is_query).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), "is_query")
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).withColumn("length", F.size("embedding"))
    lengths = rows.groupBy("length").count().orderBy(F.desc("count"), "length").first()
    schema = "query_id long, rank int, vec_id long, score double"
    if lengths is None:
        return spark.createDataFrame([], schema)
    rows = scratch.save(rows.where(F.col("length") == lengths["length"]).groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.max("is_query").alias("is_query")), "rows")
    # Equal vectors: one node, named by the smallest vec_id. Only the first k + 1 of a group can be among a query's k nearest.
    alike = rows.groupBy("embedding").agg(F.min("vec_id").alias("id"), F.count("*").alias("n"))
    nodes = scratch.save(alike, "nodes")
    members = scratch.save(rows.join(nodes.where("n > 1").withColumnRenamed("id", "node"), "embedding", "left").select("vec_id", "is_query", F.coalesce("node", "vec_id").alias("node")), "members")
    vectors = scratch.save(nodes.select("id", "embedding").mapInArrow(_encode, "id long, vector binary"), "vectors")
    edges = neighbour_graph(vectors, scratch)
    near = scratch.save(_neighbourhoods(edges, vectors, vectors.count() <= BROADCAST_ROWS).select("center", F.transform("members", lambda m: F.struct(m["id"].alias("id"), m["vector"].alias("vector"))).alias("members")), "neighbourhoods")
    asked = members.where("is_query")
    starts = asked.select(F.col("node").alias("query")).distinct().join(vectors, F.col("query") == F.col("id")).select("query", F.col("query").alias("start"), F.col("vector").alias("query_vector"))
    found = search(scratch.save(starts, "queries"), near, scratch)
    # Exact distances, then each node's first members, without the query itself.
    a, b = (nodes.select(F.col("id").alias(c), F.col("embedding").alias(f"{c}_vector")) for c in ("query", "node"))
    apart = F.sqrt(F.aggregate(F.zip_with("query_vector", "node_vector", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    exact = found.withColumnRenamed("id", "node").join(a, "query").join(b, "node").select("query", "node", apart.alias("score"))
    best = Window.partitionBy("query").orderBy("score", "node")
    exact = scratch.save(exact.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"), "exact")
    first = Window.partitionBy("node").orderBy("vec_id")
    few = members.withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1).select("node", "vec_id")
    queries = asked.select(F.col("vec_id").alias("query_id"), F.col("node").alias("query"))
    pairs = exact.join(few, "node").join(queries, "query").where("vec_id != query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
