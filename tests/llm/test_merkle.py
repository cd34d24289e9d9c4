from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from pulltally.llm import merkle

TABLE = "doc_id long, text string, lang string, source string, n_chars long, key int, leaf int, place int, path string"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, n, 1, 2, 3, "x") for i, t, lang, source, n in rows], TABLE)


def digest(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, t, lang, source, n):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, t))


def climbed(nodes):
    """The root, and each node's path of (left, right)."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i // 8 * 8:i // 8 * 8 + 8]
            paths[k].append(("".join(run[:i % 8]), "".join(run[i % 8 + 1:])))
            at[k] = i // 8
        level = [digest(level[i:i + 8]) for i in range(0, len(level), 8)]
    return level[0], paths


def expected(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    groups = [sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r))) for lang in langs]
    trees = [climbed([leaf(*r) for r in g]) for g in groups]
    root, tops = climbed([t[0] for t in trees])
    out = []
    for group, (subroot, paths), top in zip(groups, trees, tops, strict=True):
        for row, path in zip(group, paths, strict=True):
            i, t, *rest = row
            altered = i is not None and t is not None and zlib.crc32(str(i).encode()) % 3 == 0
            x = leaf(i, "".join(c.lower() if c.isascii() else c for c in t), *rest) if altered else leaf(*row)
            for left, right in path + top:
                x = digest([left, x, right])
            out.append((i, leaf(*row), subroot, root, digest(a + b for a, b in path + top), x, x == root))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in df.collect()), key=str)


@pytest.mark.parametrize("n", [1, 8, 9, 600])
def test_against_hashlib(spark, n):
    rows = [(3 * k % 1009, f"Text É {k}", ("en", "de", "fr")[k % 5 % 3], "web", k) for k in range(n)]
    assert found(merkle.check_documents(table(spark, rows))) == expected(rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None), (1, "", "", "", 0), (2, "A", None, "s", 1), (2, "A", None, "s", 1), (2, "B", None, "s", 1), (-7, "x" * 300_000, "en", None, 5)]
    rows += [(9, "Same ROW", "en", "hot", 8)] * 40 + [(k, "é漢", f"lang{k}", "s", 2) for k in range(70)]
    assert found(merkle.check_documents(table(spark, rows))) == expected(rows)


def test_empty(spark):
    assert merkle.check_documents(table(spark, [])).collect() == []
    assert merkle.build_manifest(table(spark, [])).root is None


def test_one_altered_field_changes_the_root(spark):
    rows = [(k, f"text {k}", "en", "web", k) for k in range(100)]
    one = merkle.build_manifest(table(spark, rows))
    rows[41] = (41, "text 41", "en", "Web", 41)
    other = merkle.build_manifest(table(spark, rows))
    assert one.root != other.root and one.leaves.join(other.leaves, ["key", "place", "leaf"]).count() == 99


def test_proofs_of_other_columns(spark):
    rows = [(k, f"text {k}", "en", f"site{k % 3}", k) for k in range(30)]
    manifest = merkle.build_manifest(table(spark, rows), fields=("text", "n_chars"), group="source", order="n_chars")
    walked = merkle.proofs(manifest).select(merkle.folded(F.col("leaf"), F.col("path")).alias("root")).distinct().collect()
    assert [r["root"] for r in walked] == [manifest.root]
