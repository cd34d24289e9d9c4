"""Merkle manifest of a table: a tree per group, a tree over the groups' roots, proofs, and their check.

1. Each row's leaf is the hash of its fields; leaves are written once.
2. Rows are dealt by ranges of group, order column and leaf, and sorted within each range; sizes of the ranges, added up,
   give each leaf its place in its group. No group is ever gathered in one task.
3. A level: nodes are grouped by parent (place div 8). One conditional aggregate per slot spreads a parent's children
   into eight columns; these concatenated give its hash, and those without the own slot are a child's siblings.
4. Proofs go from the root down: a node's path is its siblings and its parent's path, by a join with the parent.

Everything is DataFrame functions; a level is an eighth of the one before.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulltally.llm.scratch import Scratch

FANOUT = 8
SLOTS = [f"s{k}" for k in range(FANOUT)]
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bits of monotonically_increasing_id that count rows within a partition.
_ROW_BITS = 33


class Manifest(NamedTuple):
    """`leaves` (the given columns, `key`, `place`, `n`, `leaf`), the levels above them, the `top` nodes (key, subroot,
    path to the root) and the root's hash (None for an empty table)."""

    leaves: DataFrame
    levels: list[DataFrame]
    top: DataFrame
    root: str | None


def digest(parts: Sequence[Column]) -> Column:
    """Lower-case hex SHA-256 of the concatenated parts; null parts are left out."""
    return F.sha2(F.concat_ws("", *parts), 256)


def field(value: Column) -> Column:
    """`-` if null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: Sequence[Column]) -> Column:
    return digest([field(value) for value in fields])


def _placed(rows: DataFrame, key: str, order: Sequence[str], scratch: Scratch, name: str) -> DataFrame:
    """Adds each row's place (from 0) among those of its key, and n, their number. Nulls come first."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [key, *order]
    dealt = rows.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id())
    dealt = scratch.save(dealt.withColumn("_part", F.shiftright("_at", _ROW_BITS)), f"{name}-dealt")
    # A row for each key and range that holds it.
    runs = dealt.groupBy(key, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(key)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        key, "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"), F.sum("_rows").over(whole).alias("n"))
    runs = scratch.save(runs, f"{name}-runs")
    return dealt.join(runs, [key, "_part"]).withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def _parents(nodes: DataFrame) -> DataFrame:
    """The level above: each parent with its children in eight columns and its own hash. Single nodes have none."""
    slot = F.col("place") % FANOUT
    spread = [F.max(F.when(slot == k, F.col("digest"))).alias(name) for k, name in enumerate(SLOTS)]
    grouped = nodes.where("n > 1").groupBy("key", F.expr(f"place div {FANOUT}").alias("parent"))
    found = grouped.agg(F.expr(f"(max(n) + {FANOUT - 1}) div {FANOUT}").alias("n"), *spread)
    return found.select("key", F.col("parent").alias("place"), "n", *SLOTS, digest([F.col(s) for s in SLOTS]).alias("digest"))


def _levels(leaves: DataFrame, scratch: Scratch, name: str) -> list[DataFrame]:
    """All levels above the leaves (key, place, n, digest), each an eighth of the one below."""
    levels, nodes = [], leaves
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        nodes = scratch.save(_parents(nodes), f"{name}-{len(levels) + 1}")
        levels.append(nodes)
        most = -(-most // FANOUT)
    return levels


def _siblings(slot: Column, names: Sequence[str]) -> Column:
    """The joined hashes left and right of the own slot: of the slots' columns all but that one."""
    def beside(k: int) -> Column:
        return F.struct(F.concat_ws("", *names[:k]).alias("left"), F.concat_ws("", *names[k + 1:]).alias("right"))

    out = beside(FANOUT - 1)
    for k in reversed(range(FANOUT - 1)):
        out = F.when(slot == k, beside(k)).otherwise(out)
    return out


def _with_paths(nodes: DataFrame, above: DataFrame | None, single: DataFrame) -> DataFrame:
    """Adds subroot and path: own siblings first, then the parent's path. A key's single node has those of `single`."""
    alone = nodes.where("n = 1").join(single, "key")
    if above is None:
        return alone
    slots = [f"_{s}" for s in SLOTS]
    up = above.select("key", F.col("place").alias("_parent"), *[F.col(s).alias(f"_{s}") for s in SLOTS], "subroot", F.col("path").alias("_path"))
    rest = nodes.where("n > 1").withColumn("_parent", F.expr(f"place div {FANOUT}")).join(up, ["key", "_parent"])
    path = F.concat(F.array(_siblings(F.col("place") % FANOUT, slots)), F.col("_path"))
    return rest.select(*nodes.columns, "subroot", path.alias("path")).unionByName(alone.select(*nodes.columns, "subroot", "path"))


def _walked_down(levels: list[DataFrame], single: DataFrame, scratch: Scratch, name: str) -> DataFrame | None:
    """The lowest of the levels with the subroot and path of each node."""
    above = None
    for depth in reversed(range(len(levels))):
        above = scratch.save(_with_paths(levels[depth], above, single), f"{name}-{depth}")
    return above


def build_manifest(rows: DataFrame, fields: Sequence[str] = FIELDS, group: str = "lang", order: str = "doc_id", keep: Sequence[Column] = ()) -> Manifest:
    """Hashes every row and builds the trees. See `Manifest`; `keep` adds columns to its leaves.

    Rows of a group ascend by `order`, equal ones by their leaf; a null group and null order values come first, and
    rows that are wholly equal each count. Only the named columns are read. An empty table has no root.
    """
    scratch = Scratch(rows.sparkSession, "merkle")
    # A key that is never null and sorts as the group does, null first.
    key = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit(""))
    leaves = rows.select(F.col(order).alias("order"), *keep, key.alias("key"), leaf_digest([F.col(f) for f in fields]).alias("leaf"))
    # Numbered where it is written, so that equal rows can go to different ranges.
    leaves = scratch.save(leaves.withColumn("_row", F.monotonically_increasing_id()), "leaves")
    leaves = scratch.save(_placed(leaves, "key", ["order", "leaf", "_row"], scratch, "leaves").drop("_row"), "placed")

    nodes = leaves.select("key", "place", "n", F.col("leaf").alias("digest"))
    levels = _levels(nodes, scratch, "level")
    subroots = nodes.where("n = 1").select("key", "digest")
    for level in levels:
        subroots = subroots.unionByName(level.where("n = 1").select("key", "digest"))
    subroots = scratch.save(subroots, "subroots").select(F.col("key").alias("group"), F.col("digest").alias("subroot"), F.lit("").alias("key"))
    tops = scratch.save(_placed(subroots, "key", ["group"], scratch, "tops"), "tops")
    above = _levels(tops.select("key", "place", "n", F.col("subroot").alias("digest")), scratch, "top")
    root = above[-1].first()["digest"] if above else next((r["subroot"] for r in tops.take(1)), None)

    # The top tree has one key, whose single node is the root with an empty path.
    none = F.array().cast("array<struct<left: string, right: string>>")
    end = tops.limit(1).select("key", F.lit("").alias("subroot"), none.alias("path"))
    lowest = _walked_down(above, end, scratch, "top-paths")
    top = _with_paths(tops.select("key", "place", "n", "group", F.col("subroot").alias("own")), lowest, end)
    top = scratch.save(top.select(F.col("group").alias("key"), F.col("own").alias("subroot"), "path"), "top")
    return Manifest(leaves, levels, top, root)


def proofs(manifest: Manifest) -> DataFrame:
    """The leaves with subroot and path: (left, right) siblings of each level, up to the root."""
    scratch = Scratch(manifest.leaves.sparkSession, "merkle-proofs")
    lowest = _walked_down(manifest.levels, manifest.top, scratch, "paths")
    return _with_paths(manifest.leaves, lowest, manifest.top)


def proof_digest(path: Column) -> Column:
    """The hash of all siblings of a path, level by level, left to right."""
    return F.sha2(F.concat_ws("", F.transform(path, lambda p: F.concat(p["left"], p["right"]))), 256)


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf gives with the siblings of a path."""
    return F.aggregate(path, leaf, lambda x, p: F.sha2(F.concat(p["left"], x, p["right"]), 256))


def tampered(doc_id: Column) -> Column:
    """Whether a document's text is altered for the check: the decimal id's unsigned crc32 is divisible by 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 0, F.lit(False))


def check_documents(docs: DataFrame) -> DataFrame:
    """Builds the manifest of docs (doc_id, source, lang, n_chars, text), alters the texts of a third (`tampered`) and folds all.

    Per row: doc_id, leaf, subroot, root, proof_sha256 (untampered), folded_root and verified. Alike for nulls in any
    column (a null text can't be altered), empty texts, a single row and repeated rows; an empty table gives no row.
    """
    fields = [F.col(f) for f in FIELDS]
    other = [F.translate("text", _CAPITALS, _CAPITALS.lower()) if f == "text" else c for f, c in zip(FIELDS, fields, strict=True)]
    manifest = build_manifest(docs, keep=[F.when(tampered(F.col("doc_id")), leaf_digest(other)).alias("other_leaf")])
    root = F.lit(manifest.root).cast("string")
    out = proofs(manifest).select(
        F.col("order").alias("doc_id"), "leaf", "subroot", root.alias("root"), proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.coalesce("other_leaf", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
