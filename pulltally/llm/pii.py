"""Personal data: fixed kinds by pattern, and terms that give an entity away.

Entities are the values that the patterns find. For each entity and each word of the texts that hold it, the number
of different texts that hold both is counted over the whole corpus, as is the number of different texts that hold the
word. With p(e|t) = texts with both / texts with t, the word's pointwise mutual information with the entity, as a
share of the entity's information content -ln p(e), says how much of the entity it discloses. Words that disclose at
least DISCLOSURE of it, at the lower bound that p(e|t) has with a confidence of 95%, become spans of kind `term`
wherever they stand in texts that hold the entity. Equal texts count once. Near copies are no evidence either: of texts that
share a band of minima over their five-word shingles (as those with a similarity of 0.75 do, but for 2 in 100,000) only
one counts as a text with the entity, and the others with both entity and word don't count among those with the word.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulltally.llm.arrays import byte_chunks, mix, shingles, split_words
from pulltally.llm.near_dedup import minima
from pulltally.llm.scratch import Scratch

DISCLOSURE = 0.8
#: -ln of the chance at which a word that discloses less would be seen with the entity as often.
EVIDENCE = -math.log(0.05)
#: Shorter words never become terms.
MIN_LETTERS = 3
KINDS = ("email", "ip", "card", "phone")
#: Places in the table of candidate words for the map side; it is 4 MB whatever their number.
PLACES = 1 << 25

#: Words counted in a task before they are handed on.
HELD = 1 << 20
#: Up to this number of texts with copies (16 MB) tasks know how many each has; of more, words are handed on text by text.
COPIES = 1_000_000
#: Bands that tell near copies, and minima in each.
BANDS, ROWS = 20, 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number can only start a match at its first digit, which keeps the search linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^\W\d_]+")
_DIGITS = re.compile(r"[0-9]")

_SEPARATORS = np.zeros(256, bool)
_SEPARATORS[:128] = True
_SEPARATORS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = False


def _luhn(digits: str) -> bool:
    doubled = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As a leftmost search for local part, @ and domain finds them, starting from each @."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then by start."""
    found = [("email", a, b) for a, b in _emails(text)]
    if not _DIGITS.search(text):
        return found
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_DIGITS.findall(m[0])) <= 15:
            found.append(("phone", m.start(), m.end()))
    return found


def _entity(kind: str, value: str) -> str:
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else ''.join(_DIGITS.findall(value))}"


def words_outside(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """(word, start, end) of the lower-cased words of MIN_LETTERS or more that don't touch a span."""
    taken: list[list[int]] = []
    for a, b in sorted((a, b) for _, a, b in spans):
        if taken and a < taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    k = 0
    for m in _WORD.finditer(text):
        while k < len(taken) and taken[k][1] <= m.start():
            k += 1
        if m.end() - m.start() >= MIN_LETTERS and (k == len(taken) or m.end() <= taken[k][0]):
            yield m[0].lower(), m.start(), m.end()


def _ascii_lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, entity) of each entity of a text, once."""
    for batch in batches:
        rows = []
        for key, value in zip(batch.column("text_key").to_pylist(), batch.column("text"), strict=True):
            text = value.as_py() or ""
            rows += [(key, e) for e in sorted({_entity(kind, text[a:b]) for kind, a, b in base_spans(text)})]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.array([e for _, e in rows], pa.string())], ["text_key", "entity"])


def _marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    place = hashes & np.uint64(PLACES - 1)
    return (table[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _places(hashes: DataFrame) -> bytes:
    """A table of bits, one set for each value of the column hash."""
    place = f"(hash & {PLACES - 1})"
    words = hashes.groupBy(F.expr(f"{place} div 64").alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast({place} % 64 as int))")).alias("bits")).toPandas()
    table = np.zeros(PLACES // 64, np.int64)
    table[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return table.tobytes()


def _beside(table: bytes):
    def beside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(text_key, term) of each word of the texts in the table, once per row."""
        places = np.frombuffer(table, np.uint8)
        for batch in batches:
            keys = batch.column("text_key").to_numpy().astype(np.int64)
            for k in np.flatnonzero(_marked(places, keys.view(np.uint64))).tolist():
                text = batch.column("text")[k].as_py() or ""
                terms = sorted({w for w, _, _ in words_outside(text, base_spans(text))})
                yield pa.RecordBatch.from_arrays([pa.array([int(keys[k])] * len(terms), pa.int64()), pa.array(terms, pa.string())], ["text_key", "term"])

    return beside


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text_key, bands) of each text; none without words."""
    places = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        for first, last, data, offsets in byte_chunks(batch.column("text")):
            found = []
            for s in shingles(data, offsets).sets():
                rows = minima(s, BANDS * ROWS).astype(np.uint64).reshape(BANDS, ROWS)
                hashed = places
                for k in range(ROWS):
                    hashed = mix(hashed * np.uint64(1 << 32) ^ hashed ^ rows[:, k])
                found.append(hashed.view(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column("text_key").slice(first, last - first), pa.array(found, pa.list_(pa.int64()))], ["text_key", "bands"])


def counted_texts(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """The keys of texts (text_key, text) that count: those with the smallest key in each of their bands."""
    sketched = scratch.save(keyed.mapInArrow(_bands, "text_key long, bands array<long>"), "bands")
    least = sketched.select("text_key", F.explode("bands").alias("band")).groupBy("band").agg(F.min("text_key").alias("text_key"))
    first = least.groupBy("text_key").agg(F.count("*").alias("n")).where(F.col("n") == BANDS).select("text_key")
    return scratch.save(first.union(sketched.where("size(bands) = 0").select("text_key").distinct()), "counted")


def _term_hash(term: str) -> int:
    data = np.frombuffer(_ascii_lower(term).encode(), np.uint8)
    return int(split_words(data, np.array([0, len(data)]), _SEPARATORS).hashes()[:1].view(np.int64)[0])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("term"), pa.array([_term_hash(t) for t in batch.column("term").to_pylist()], pa.int64())], ["term", "hash"])


def _holder(table: bytes, copies: bytes, known: tuple[np.ndarray, np.ndarray]):
    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Hashes of the candidate words that each text holds, once per text: counted, or with the key of texts that may have copies.

        A text that is known (key, number) to stand there n times counts 1 / n each time."""
        places, repeated = np.frombuffer(table, np.uint8), np.frombuffer(copies, np.uint8)
        pending: list[tuple[np.ndarray, np.ndarray]] = []

        def rows(hashes: np.ndarray, keys: np.ndarray | None, n: np.ndarray) -> pa.RecordBatch:
            named = pa.nulls(len(hashes), pa.int64()) if keys is None else pa.array(keys)
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), named, pa.array(n.astype(float))], ["hash", "text_key", "n"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate([h for h, _ in pending]), return_inverse=True)
            return found, np.bincount(at, np.concatenate([n for _, n in pending]), len(found))

        for batch in batches:
            keys = batch.column("text_key").to_numpy().astype(np.int64)
            for first, last, data, offsets in byte_chunks(batch.column("text")):
                words = split_words(data, offsets, _SEPARATORS)
                hashes, owner = words.hashes(), words.docs()
                hit = _marked(places, hashes)
                pairs = np.unique(np.stack([owner[hit].astype(np.uint64), hashes[hit]]), axis=1) if hit.any() else np.zeros((2, 0), np.uint64)
                key = keys[first:last][pairs[0].astype(np.int64)]
                again = _marked(repeated, key.view(np.uint64))
                if again.any():
                    yield rows(pairs[1][again], key[again], np.ones(int(again.sum())))
                weight = np.ones(len(key))
                if len(known[0]):
                    place = np.minimum(np.searchsorted(known[0], key), len(known[0]) - 1)
                    weight = np.where(known[0][place] == key, 1 / known[1][place], 1.0)
                found, at = np.unique(pairs[1][~again], return_inverse=True)
                pending.append((found, np.bincount(at, weight[~again], len(found))))
                if sum(len(h) for h, _ in pending) > HELD:
                    pending = [merged()]
                    if len(pending[0][0]) > HELD // 2:
                        yield rows(pending[0][0], None, pending[0][1])
                        pending = []
        if pending:
            found, n = merged()
            yield rows(found, None, n)

    return hold


def disclosing_terms(docs: DataFrame) -> DataFrame | None:
    """(text_key, terms): per text the words that disclose an entity of it; None if there are none."""
    scratch = Scratch(docs.sparkSession, "pii")
    keyed = docs.where("text is not null").select(F.xxhash64("text").alias("text_key"), "text")
    found = scratch.save(keyed.mapInArrow(_entities, "text_key long, entity string").distinct(), "entities")
    counted = counted_texts(keyed, scratch)
    n_texts = float(counted.count())
    if not n_texts:
        return None
    # The least p(e|t) that discloses enough: (ln p(e|t) - ln p(e)) / -ln p(e) >= DISCLOSURE.
    least = F.pow(F.least(F.col("n_entity") / n_texts, F.lit(1 - 1e-9)), F.lit(1 - DISCLOSURE))
    found = found.join(counted.withColumn("counts", F.lit(True)), "text_key", "left")
    entities = found.groupBy("entity").agg(F.count_if("counts").alias("n_entity"), F.count("*").alias("n_all")).withColumn("least", least)
    # Words that stand with the entity only and in all of its texts are the best evidence there can be.
    entities = entities.where(-F.col("n_entity") * F.log("least") >= EVIDENCE)
    live = scratch.save(found.join(entities, "entity"), "live")
    if live.isEmpty():
        return None
    texts = live.select("text_key").distinct()
    words = keyed.mapInArrow(_beside(_places(texts.select(F.col("text_key").alias("hash")))), "text_key long, term string")
    words = scratch.save(words.distinct().join(texts, "text_key", "left_semi"), "words")
    # Only words with enough texts beside an entity to be evidence, were they nowhere else, are counted in the whole corpus.
    pairs = live.join(words, "text_key").groupBy("entity", "term").agg(
        F.count_if("counts").alias("both"), F.count("*").alias("all"), F.first("least").alias("least"))
    pairs = scratch.save(pairs.where(-F.col("both") * F.log("least") >= EVIDENCE), "pairs")
    terms = scratch.save(pairs.select("term").distinct().mapInArrow(_hashed, "term string, hash long"), "terms")
    copies = scratch.save(keyed.groupBy("text_key").agg(F.count("*").alias("n")).where("n > 1"), "copies")
    known = np.zeros(0, np.int64), np.zeros(0)
    if copies.count() <= COPIES:
        got = copies.orderBy("text_key").toPandas()
        known = got["text_key"].to_numpy(np.int64), got["n"].to_numpy(float)
        copies = copies.limit(0)
    marked = _places(copies.select(F.col("text_key").alias("hash")))
    held = keyed.mapInArrow(_holder(_places(terms), marked, known), "hash long, text_key long, n double")
    once = held.groupBy("hash", "text_key").agg(F.sum("n").alias("n")).select("hash", F.when(F.col("text_key").isNull(), F.col("n")).otherwise(1.0).alias("n"))
    held = once.groupBy("hash").agg(F.round(F.sum("n")).cast("long").alias("holding"))  # whole but for rounding
    held = scratch.save(terms.join(held, "hash").select("term", "holding"), "held")
    pairs = pairs.join(held, "term").withColumn("holding", F.col("holding") - (F.col("all") - F.col("both")))
    strong = scratch.save(pairs.where(_passes(F.col("both"), F.greatest("holding", "both", F.lit(1)), F.col("least"))).select("entity", "term"), "strong")
    some = words.join(strong.select("term").distinct(), "term", "left_semi")
    flagged = some.join(live.select("text_key", "entity"), "text_key").join(strong, ["entity", "term"], "left_semi")
    flagged = scratch.save(flagged.groupBy("text_key").agg(F.collect_set("term").alias("terms")), "flagged")  # at most the words of the text
    return None if flagged.isEmpty() else flagged


def _passes(both: Column, holding: Column, least: Column) -> Column:
    """Whether p(e|t) is at least `least` with a confidence of 1 - exp(-EVIDENCE), by Chernoff's bound."""
    share = both / holding
    rest = F.when(both < holding, (holding - both) * F.log((1 - share) / (1 - least))).otherwise(0.0)
    return (share > least) & (both * F.log(share / least) + rest >= EVIDENCE)  # never without a text that holds both


def all_spans(text: str, terms: list[str] | None) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    if not terms:
        return base
    wanted = set(terms)
    extra = [("term", a, b) for w, a, b in words_outside(text, base) if w in wanted]
    return base + extra



def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each stretch of overlapping spans becomes one mark; terms become [NAME] if capitalised, else [TERM]."""
    out, done = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= done:
            mark = ("NAME" if text[a].isupper() else "TERM") if kind == "term" else kind.upper()
            out.append(f"{text[done:a]}[{mark}]")
        done = max(done, b)
    return "".join(out) + text[done:]


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds `spans` and `redacted` (null texts stay null) in place of the last two columns, text and terms."""
    for batch in batches:
        spans, redacted = [], []
        for text, terms in zip(batch.columns[-2], batch.columns[-1], strict=True):
            text = text.as_py()
            found = all_spans(text or "", terms.as_py())
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
            redacted.append(None if text is None else redact(text, found) if found else text)
        columns = [*batch.columns[:-2], pa.array(spans, _SPANS), pa.array(redacted, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names[:-2], "spans", "redacted"])


def personal_data(docs: DataFrame) -> DataFrame:
    """Every row of docs with two more columns: `kept` (a struct of all its columns), spans and redacted.

    docs needs a column text; others may have any name. spans lists kind, start and end (code points, end exclusive)
    by kind - email, ip, card, phone, term - and start. Null and empty texts have none; equal texts have equal spans.
    """
    texts = docs.select(F.col("text").cast("string").alias("text"))
    terms = disclosing_terms(texts)
    kind = "array<string>"
    rows = docs.select(F.struct("*").alias("kept"), F.col("text").cast("string").alias("text"))
    if terms is None:
        rows = rows.withColumn("terms", F.lit(None).cast(kind))
    else:
        rows = rows.withColumn("text_key", F.xxhash64("text")).join(terms, "text_key", "left").select("kept", "text", "terms")
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([rows.schema["kept"], T.StructField("spans", T.ArrayType(span)), T.StructField("redacted", T.StringType())])
    return rows.mapInArrow(_finder, schema)
