"""The registered queries over the sample tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulltally.llm import decontaminate, hard_negatives, html_text, licenses, merkle, near_dedup, neighbours, packing, pii, secrets, token_files, toxicity, warc
from pulltally.llm.scratch import Scratch
from pulltally.llm.shipping import ship_package
from pulltally.llm.tokens import public_tokenizer


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op3").folder("ids")
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizer("word_bpe_49k.json"))
    return token_files.read_token_files(spark, path)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return html_text.extract_text(pages, html_text.fit(pages)).withColumn("n_chars", F.char_length("text").cast("long"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "term")
    return found.select(F.col("kept.doc_id").alias("doc_id"), *map(_count, pii.KINDS), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_notices(_table(spark, sf_dir, "documents"))
    labels = F.array_sort(F.array_distinct(F.concat("base_labels", F.col("blocks.label"))))
    best = F.coalesce(F.array_max("blocks.containment"), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"), F.when(F.col("n_base") > 0, 1.0).otherwise(best).alias("score"), "blocks",
    )


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op7").folder("archives")
    warc.write_archives(_table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(_table(spark, sf_dir, "documents"), public_tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scores = toxicity.toxic_scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    doc_id = F.col("kept.doc_id")
    held_out = F.coalesce(toxicity.held_out(doc_id), F.lit(False))
    return scores.select(doc_id.alias("doc_id"), held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages")


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secrets.secret_spans(docs, secrets.fit(secrets.labelled_samples(docs)))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select(
        F.col("kept.doc_id").alias("doc_id"), *[_count(kind) for kind in secrets.KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.check_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id, label = F.col("vec_id"), F.col("label")
    shifted = _table(spark, sf_dir, "embeddings").withColumn("label", F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label))
    return hard_negatives.hard_negatives(shifted, vec_id % 50 == 0)


QUERIES = {
    f.__name__: f for f in (
        op1_near_dedup, op2_decontaminate, op3_token_files, op4_html_text, op5_personal_data, op6_licenses, op7_warc, op8_packing,
        op9_toxicity, op10_neighbours, op11_secrets, op12_merkle, op13_hard_negatives)
}

_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _shingle_sql(name: str, table: str, key: str) -> str:
    """Distinct shingles of each row, as the tables {name}_s (key, sh) and {name}_n (key, n)."""
    return f"""
{name}_w AS (
    SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{_CAPITALS}', '{_CAPITALS.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM {table}
), {name}_s AS (
    SELECT DISTINCT {key}, unnest(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh
    FROM {name}_w
), {name}_n AS (SELECT {key}, count(*) AS n FROM {name}_s GROUP BY {key})"""


def _merkle_sql(levels: int = 8, top_levels: int = 4) -> str:
    """Trees of up to 8**levels rows per lang and 8**top_levels langs."""
    def field(value: str) -> str:
        return f"coalesce(strlen({value}::VARCHAR) || ':' || {value}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    # The crc32 of the decimal id: each byte, then its eight shifts (marked by -1).
    steps = "list_concat([0::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce({steps}, lambda r, b: CASE WHEN b >= 0 THEN xor(r, b) WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, 4294967295), 4294967295)"
    lowered = f"translate(text, '{_CAPITALS}', '{_CAPITALS.lower()}')"
    parts = [f"""
leaves AS (
    SELECT doc_id, lang, {leaf('text')} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {leaf(lowered)} ELSE {leaf('text')} END AS x FROM documents
), l0 AS (
    SELECT doc_id, lang, leaf, leaf AS d, x, '' AS proof,
        row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM leaves
)"""]

    def climb(name: str, depth: int, key: str, rows: str) -> str:
        """Nodes one level higher, and the leaves' walk there: their node, the hash of it as altered, and the siblings passed."""
        nodes, up = f"{name}{depth}", f"{name}{depth + 1}"
        same = f"a.{key} IS NOT DISTINCT FROM p.{key}" if key else "true"
        group = f"{key}, " if key else ""
        return f"""
{up} AS (
    SELECT {group}i // 8 AS i, (max(n) + 7) // 8 AS n, list(d ORDER BY i) AS ds, sha256(string_agg(d, '' ORDER BY i)) AS d
    FROM (SELECT DISTINCT {group}i, n, d FROM {nodes}) WHERE n > 1 GROUP BY {group}i // 8
    UNION ALL SELECT DISTINCT {group}i, n, NULL, d FROM {nodes} WHERE n = 1
), {rows}{depth + 1} AS (
    SELECT a.* REPLACE (
        CASE WHEN ds IS NULL THEN a.i ELSE p.i END AS i, p.n AS n, p.d AS d,
        CASE WHEN ds IS NULL THEN x ELSE sha256(array_to_string(ds[1:a.i % 8], '') || x || array_to_string(ds[a.i % 8 + 2:], '')) END AS x,
        CASE WHEN ds IS NULL THEN proof ELSE proof || array_to_string(ds[1:a.i % 8], '') || array_to_string(ds[a.i % 8 + 2:], '') END AS proof)
    FROM {rows}{depth} a JOIN {up} p ON {same} AND p.i = CASE WHEN a.n > 1 THEN a.i // 8 ELSE a.i END
)"""

    parts += ["w0 AS (SELECT * FROM l0)"] + [climb("l", k, "lang", "w") for k in range(levels)]
    parts.append(f"""
t0 AS (
    SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT lang, d FROM w{levels})
), v0 AS (
    SELECT w.* REPLACE (t.i AS i, t.n AS n), w.d AS subroot FROM w{levels} w JOIN t0 t ON w.lang IS NOT DISTINCT FROM t.lang
)""")
    parts += [climb("t", k, "", "v") for k in range(top_levels)]
    return f"""
WITH {','.join(parts)}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = d AS verified FROM v{top_levels}"""


#: SQL can't tokenize, learn, or give places of matches in code points; those operators are tested against brute force.
ORACLE: dict[str, str] = {
    "op1_near_dedup": f"""
WITH RECURSIVE {_shingle_sql('d', 'documents', 'doc_id')}, pairs AS (
    SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM d_s a JOIN d_s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
    SELECT x, y FROM pairs JOIN d_n a ON a.doc_id = x JOIN d_n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)
), reach AS (
    SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
), least AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN least USING (doc_id) LEFT JOIN d_n USING (doc_id)""",
    "op2_decontaminate": f"""
WITH {_shingle_sql('d', 'documents', 'doc_id')}, {_shingle_sql('i', 'benchmark', 'item_id')}
SELECT doc_id, item_id, n AS n_item, count(*) AS n_shared, count(*) / n AS containment
FROM d_s JOIN i_s USING (sh) JOIN i_n USING (item_id) GROUP BY doc_id, item_id, n HAVING 100 * count(*) >= 75 * n""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS digest, strlen(coalesce(html, '')) AS n FROM pages),
last AS (SELECT digest, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY digest)
SELECT page_id, n AS payload_bytes, digest AS payload_digest,
    CASE WHEN m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN m <> page_id THEN m END AS refers_to, NULL::VARCHAR AS error
FROM p LEFT JOIN last USING (digest)""",
    "op12_merkle": _merkle_sql(),
    "op13_hard_negatives": """
WITH v AS (
    SELECT row_number() OVER () AS i, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.i, a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_sum(list_transform(list_zip(a.e, b.e), lambda z: z[1] * z[2]))::BIGINT AS score
    FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
), p AS (
    SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, vec_id) AS r FROM s WHERE same QUALIFY r <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.i, p.r ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank,
    s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.i = p.i AND NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score QUALIFY rank <= 3""",
}
