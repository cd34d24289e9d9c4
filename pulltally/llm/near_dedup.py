"""Near-duplicate documents: MinHash bands find candidates, full shingle sets confirm them.

1. Each text becomes its set of five-word shingles (64-bit hashes), two set fingerprints and 128 minima
   of universal hash functions. Texts with equal sets share both fingerprints (128 bits) and count as one node.
2. The minima form 32 bands of four. In every band, each node is held against the smallest node that
   shares the band: by signature first, then by the full sets. This links almost every group, with
   one candidate per node and band however large a group is.
3. Where a band still holds nodes of different components, these are compared with each other: those of bands of up to
   FEW nodes in pairs made by a join, once over all bands; those of larger bands in blocks of bounded size, across components
   only (never within the largest). By signature first, then by full sets. So no link between different texts is left out.
4. Components come from alternating large-star and small-star.

Two sets with a similarity of exactly 0.75 share no band with a chance of 5e-6, of 0.8 with 5e-8.
A signature rejects a pair only if its estimate is below 0.55; at a true 0.75 that has a chance below 1e-6.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulltally.llm.arrays import byte_chunks, mix, random_words, shingles
from pulltally.llm.components import connected_components
from pulltally.llm.scratch import Scratch

MINIMA = 128
ROWS = 4
BANDS = MINIMA // ROWS
#: Pairs below this estimated similarity are not looked at further.
ESTIMATE = 0.55
#: Bands of up to so many nodes are paired by a join.
FEW = 16
#: Nodes of a larger band that are compared in one go.
BLOCK = 256
#: Shares that rows with one text are dealt to.
SHARES = 32

_A = random_words(MINIMA, 11) | np.uint64(1)
_B = random_words(MINIMA, 12)
_FINGERPRINTS = random_words(2, 13)


def minima(hashes: np.ndarray, n: int = MINIMA) -> np.ndarray:
    """The smallest value of each of the first n universal hash functions over a set, as 32-bit numbers."""
    least = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), 4096):
        part = hashes[k:k + 4096]
        np.minimum(least, (part[None, :] * _A[:n, None] + _B[:n, None]).min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def fingerprint(hashes: np.ndarray, which: int = 0) -> int:
    """One number for a set of hashes, whatever their order; there are two."""
    total = mix(hashes ^ _FINGERPRINTS[which]).sum(dtype=np.uint64) + np.uint64(len(hashes))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offsets in byte_chunks(batch.column("text")):
            count, node, check, signature = [], [], [], []
            for s in shingles(data, offsets).sets():
                count.append(len(s))
                node.append(fingerprint(s) if len(s) else None)
                check.append(fingerprint(s, 1) if len(s) else None)
                signature.append(minima(s).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).slice(first, last - first) for c in ("doc_id", "text_key")), *(pa.array(c, pa.int64()) for c in (count, node, check)), pa.array(signature, pa.list_(pa.int32()))],
                ["doc_id", "text_key", "n_shingles", "node", "check", "signature"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, _, data, offsets in byte_chunks(batch.column("text")):
            sets = [s for s in shingles(data, offsets).sets() if len(s)]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array([fingerprint(s, k) for s in sets], pa.int64()) for k in (0, 1)), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                ["node", "check", "shingles"],
            )


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n_shingles, node and check (set fingerprints; null without words) and signature of each row."""
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("text_key"), F.col("text").cast("string"))
    return rows.mapInArrow(_signed, "doc_id long, text_key long, n_shingles long, node long, check long, signature array<int>")


def _apart(rows: DataFrame, clashes: DataFrame | None) -> DataFrame:
    """Rows (node, check, ...) in which sets that share a node but not the check have nodes of their own."""
    if clashes is None:
        return rows
    other = F.when(F.col("_least") != F.col("check"), F.xxhash64("node", "check")).otherwise(F.col("node"))
    return rows.join(F.broadcast(clashes), "node", "left").withColumn("node", F.coalesce(other, "node")).drop("_least")


def _full_sets(docs: DataFrame, signed: DataFrame, nodes: DataFrame, clashes: DataFrame | None, scratch: Scratch, name: str) -> DataFrame:
    """(node, shingles) of the given nodes, from the text of one document of each."""
    wanted = signed.select("doc_id", "node").join(nodes, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").select("text")
    sets = _apart(texts.mapInArrow(_sets, "node long, check long, shingles array<long>"), clashes)
    return scratch.save(sets.join(nodes, "node", "left_semi").select("node", "shingles").dropDuplicates(["node"]), name)


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _cross_pairs(group: pd.DataFrame) -> Iterator[tuple[int, np.ndarray]]:
    """Row i with those rows of the other side (or after it) that lie in another component and look similar.

    A group is a block of a band against itself, or against another block; `own` marks the first block's rows.
    """
    component, own = group["component"].to_numpy(), group["own"].to_numpy()
    signature = np.stack(group["signature"].to_numpy())
    alone = bool(own.all())
    for i in np.flatnonzero(own):
        rest = np.arange(i + 1, len(group)) if alone else np.flatnonzero(~own)
        rest = rest[component[rest] != component[i]]
        if len(rest):
            yield i, rest[(signature[rest] == signature[i]).mean(axis=1) >= ESTIMATE]


def _partnered(group: pd.DataFrame) -> pd.DataFrame:
    """The nodes, with their band, that have a partner in another component of their block pair."""
    found = np.zeros(len(group), bool)
    for i, partners in _cross_pairs(group):
        found[partners] = True
        found[i] |= len(partners) > 0
    return group.loc[found, ["band", "node"]].drop_duplicates()


def _linker(percent: int):
    def link(group: pd.DataFrame) -> pd.DataFrame:
        """Links between components of a block pair, one for each two that are joined."""
        parent = {c: c for c in group["component"]}

        def root(c: int) -> int:
            while parent[c] != c:
                parent[c] = c = parent[parent[c]]
            return c

        node, component, sets = group["node"].to_numpy(), group["component"].to_numpy(), group["shingles"].to_numpy()
        links = []
        for i, partners in _cross_pairs(group):
            for j in partners:
                a, b = root(component[i]), root(component[j])
                if a != b and _similar(sets[i], sets[j], percent):
                    parent[a] = b
                    links.append((node[i], node[j]))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")

    return link


def _block_pairs(members: DataFrame) -> DataFrame:
    """Members of a band (band, node, component) in the pairs of blocks that hold pairs across components.

    The band's largest component needs no comparison within itself. So its blocks meet only those of the rest, and
    the rest's blocks meet all: where few nodes are left beside a large group, each of its nodes comes but once.
    A block has about BLOCK nodes.
    """
    sizes = members.groupBy("band", "component").agg(F.count("*").alias("n"))
    bands = sizes.groupBy("band").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.ceil(F.max("n") / BLOCK).cast("int").alias("main_blocks"),
        F.greatest(F.lit(1), F.ceil((F.sum("n") - F.max("n")) / BLOCK)).cast("int").alias("rest_blocks"),
    )
    main, block, other, rest = F.col("component") == F.col("main"), F.col("block"), F.col("other"), F.col("rest_blocks")
    others = F.when(main, F.sequence(F.lit(0), rest - 1)).otherwise(F.sequence(F.lit(0), rest + F.col("main_blocks") - 1))
    return (
        members.join(bands, "band")
        .withColumn("block", F.pmod(F.xxhash64("node", "band"), F.when(main, F.col("main_blocks")).otherwise(rest)).cast("int"))
        .withColumn("other", F.explode(others))
        .withColumn("meets_main", ~main & (other >= rest))
        .withColumns({
            "low": F.when(main, other).when(F.col("meets_main"), block).otherwise(F.least("block", "other")),
            "high": F.when(main, rest + block).when(F.col("meets_main"), other).otherwise(F.greatest("block", "other")),
            "own": F.when(main, F.lit(False)).when(F.col("meets_main"), F.lit(True)).otherwise(block <= other),
        })
    )


def near_duplicate_classes(docs: DataFrame, threshold_percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, text_key and class of every row of `docs` (doc_id, text; other columns are ignored).

    Links join rows whose sets have 100 * intersection >= threshold_percent * union; component_id is the
    smallest doc_id reachable, kept says doc_id = component_id. Null, empty and blank texts have no
    shingles and are linked with nothing. Rows that repeat a doc_id are linked by their texts alone; text_key (xxhash64 of
    the text) tells them apart, and class is one number for each group, null without shingles. A row without doc_id
    joins no group that is reported: its component_id is null and it is kept.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    parts_wanted = int(spark.conf.get("spark.sql.shuffle.partitions"))
    signed = scratch.save(signatures(docs), "signed")

    def known_rows() -> DataFrame:
        return signed.where("doc_id is not null and node is not null")

    # Nodes, each with one of its equal signatures, and the bands that at least two nodes share.
    firsts = known_rows().groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("check").alias("_least"), F.max("check").alias("_most"))
    firsts = scratch.save(firsts, "firsts")
    clashes = firsts.where("_least != _most").select("node", "_least")
    clashes = None if clashes.isEmpty() else clashes  # none are to be expected in 2**32 texts
    if clashes is not None:
        signed = scratch.save(_apart(signed, clashes), "signed-apart")
        firsts = known_rows().groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    nodes = scratch.save(known_rows().join(firsts.select("node", "doc_id"), ["node", "doc_id"], "left_semi").dropDuplicates(["node"]).select("node", "signature"), "nodes")
    bands = F.array(*[F.xxhash64(F.lit(b), F.slice("signature", b * ROWS + 1, ROWS)) for b in range(BANDS)])
    banded = nodes.select("node", F.explode(bands).alias("band"))
    shared = banded.groupBy("band").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = scratch.save(banded.join(shared, "band").select("band", "node", "pivot"), "members")

    def signed_pairs(pairs: DataFrame) -> DataFrame:
        a, b = (nodes.select(F.col("node").alias(c), F.col("signature").alias(f"{c}_signature")) for c in "uv")
        equal = F.aggregate(F.zip_with("u_signature", "v_signature", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        return pairs.join(a, "u").join(b, "v").where(equal >= ESTIMATE * MINIMA).select("u", "v")

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node")))

    def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
        both = F.size(F.array_intersect("u_set", "v_set"))
        u_sets, v_sets = (sets.select(F.col("node").alias(c), F.col("shingles").alias(f"{c}_set")) for c in "uv")
        return pairs.join(u_sets, "u").join(v_sets, "v").where(100 * both >= threshold_percent * (F.size("u_set") + F.size("v_set") - both)).select("u", "v")

    pairs = scratch.save(signed_pairs(members.where("node != pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v")).distinct()), "pairs")
    sets = _full_sets(docs, signed, ends(pairs).distinct(), clashes, scratch, "sets")
    links = scratch.save(confirmed(pairs, sets), "links")
    parts = scratch.save(connected_components(links, scratch, "parts"), "parts")

    # Bands that still hold several components.
    labelled = members.join(parts, "node", "left").select("band", "node", F.coalesce("component", "node").alias("component"))
    labelled = scratch.save(labelled, "labelled")
    open_bands = labelled.groupBy("band").agg(F.min("component").alias("a"), F.max("component").alias("b"), F.count("*").alias("n")).where("a != b")
    open_bands = scratch.save(open_bands.select("band", "n"), "open")
    few = labelled.join(open_bands.where(F.col("n") <= FEW), "band", "left_semi")
    u_side, v_side = (few.select("band", F.col("node").alias(c), F.col("component").alias(f"{c}_part")) for c in "uv")
    across = u_side.join(v_side, "band").where("u < v and u_part != v_part").select("u", "v").distinct()
    near = scratch.save(signed_pairs(across), "near")

    def in_blocks(rows: DataFrame, function, kind: str) -> DataFrame:
        keys = ["band", "low", "high"]
        return _block_pairs(rows).repartition(parts_wanted, *keys).groupBy(*keys).applyInPandas(function, kind).distinct()

    many = labelled.join(open_bands.where(F.col("n") > FEW), "band", "left_semi")
    partnered = scratch.save(in_blocks(many.join(nodes, "node"), _partnered, "band long, node long"), "partnered")
    some = ends(near).union(partnered.select("node")).distinct()
    if not some.isEmpty():
        sets = _full_sets(docs, signed, some, clashes, scratch, "more-sets")
        # Only in the bands where they have partners; signature and set of a node meet once.
        whole = sets.join(partnered.select("node").distinct(), "node", "left_semi").join(nodes, "node")
        again = many.join(partnered, ["band", "node"], "left_semi").join(whole, "node")
        more = confirmed(near, sets).union(in_blocks(again, _linker(threshold_percent), "u long, v long"))
        links = links.union(scratch.save(more, "more-links"))
        parts = scratch.save(connected_components(links, scratch, "parts-again"), "all-parts")

    # Texts with very many copies meet their class in shares.
    rows = signed.select("doc_id", "text_key", "n_shingles", "node").withColumn("share", F.pmod(F.xxhash64("doc_id"), F.lit(SHARES)).cast("int"))
    held = rows.where("node is not null").groupBy("node", "share").agg(F.min("doc_id").alias("least"))
    held = scratch.save(held.join(parts, "node", "left").withColumn("class", F.coalesce("component", "node")).drop("component"), "held")
    by_node = held.groupBy("class", "node").agg(F.min("least").alias("least"))
    smallest = scratch.save(by_node.groupBy("class").agg(F.min("least").alias("_first")), "smallest")
    named = held.select("node", "share", "class").join(smallest, "class")
    out = rows.join(named, ["node", "share"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("_first", "doc_id"))
    kept = F.coalesce(component, F.lit(0)) == F.coalesce("doc_id", F.lit(0))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_key", "class")
