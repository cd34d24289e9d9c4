"""Secrets: fixed forms by pattern, and strings that character Markov models hold for random.

Two first-order Markov models over characters are trained from labelled samples, strings marked as random or as ordinary
identifiers. A token is a run of MIN_TOKEN or more characters of the kind that keys consist of. It becomes a span of kind
`random` where its log-likelihood under the random model exceeds that under the ordinary one by the model's threshold.

`labelled_samples` gives the samples of a corpus: its words and identifiers too short to be keys, each different one once, and
as random strings the values that the patterns find, with DRAWN digests in each usual alphabet. All of it, training and
search, is DataFrame functions; the models' transitions (at most 128 * 128) are the only thing that reaches the driver.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASSIGN = r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
#: No shorter match of these two can hold a longer one, so the least length stands in the pattern.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex")
MIN_VALUE = 6

#: Tokens judged by the models.
MIN_TOKEN = 16
TOKEN = "[A-Za-z0-9+/_=-]"
#: Words and identifiers that the ordinary model learns from; they are shorter than any token that is judged.
MIN_WORD = 3
#: Digests drawn for the random model, each in four alphabets.
DRAWN = 2000
#: Added to each transition's count, in a table of SIGNS characters.
SMOOTHING = 0.5
SIGNS = 66
#: Places per character in the table of transitions; 0 stands before the first and after the last.
_WIDTH = 128

_FOUND = "array<struct<start: int, place: int, kind: string, end: int, llr: double>>"


class Model(NamedTuple):
    """Log-likelihood ratio of each transition, at 128 * first + second, and the sum that a token must exceed."""

    ratios: Sequence[float]
    threshold: float


def _values(text: Column) -> Column:
    """The values that the patterns find in a text."""
    assigned = F.filter(F.regexp_extract_all(text, F.lit(ASSIGN), F.lit(2)), lambda v: F.char_length(v) >= MIN_VALUE)
    return F.concat(assigned, *[F.regexp_extract_all(text, F.lit(p), F.lit(0)) for p in (ACCESS, HEX)])


def drawn_strings(spark: SparkSession, n: int = DRAWN) -> DataFrame:
    """Random strings: digests of numbers, as they appear in hex, base 64, url-safe base 64 and capitals with digits."""
    number = F.col("id").cast("string")
    hashed = F.sha2(number, 256)
    encoded = F.base64(F.unhex(hashed))
    forms = [F.substring(hashed, 1, 40), F.rtrim(encoded, F.lit("=")), F.translate(F.rtrim(encoded, F.lit("=")), "+/", "-_"),
             F.regexp_replace(F.upper(encoded), "[^A-Z0-9]", "")]
    return spark.range(n).select(F.explode(F.array(*forms)).alias("token"))


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(token, random): different words and identifiers of all texts, and strings known to be random."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = texts.select(F.explode(F.regexp_extract_all("text", F.lit(f"{TOKEN}+"), F.lit(0))).alias("token"))
    ordinary = words.where(F.length("token").between(MIN_WORD, MIN_TOKEN - 1)).distinct()
    values = texts.select(F.explode(_values(F.col("text"))).alias("token")).where(F.length("token") >= MIN_TOKEN).distinct()
    random = values.unionByName(drawn_strings(docs.sparkSession))
    return ordinary.withColumn("random", F.lit(False)).unionByName(random.withColumn("random", F.lit(True)))


def _signs(token: Column) -> Column:
    """The characters' codes (0 for those beyond ASCII). The last code is followed by 0."""
    code = F.transform(F.split(token, ""), lambda c: F.when(F.ascii(c) < _WIDTH, F.ascii(c)).otherwise(F.lit(0)))
    return F.concat(code, F.array(F.lit(0)))


def _places(token: Column) -> Column:
    """Places of a token's transitions, from before its first character to after its last."""
    signs = _signs(token)
    return F.zip_with(F.concat(F.array(F.lit(0)), F.slice(signs, 1, F.size(signs) - 1)), signs, lambda a, b: a * _WIDTH + b)


def fit(samples: DataFrame) -> Model:
    """Trains both models from labelled samples (token string, random boolean). Null or empty tokens don't count.

    A token is taken for random where the odds that the samples give, one random string to so many ordinary ones, are
    outweighed by its likelihoods; never below even odds. Without samples every ratio is 0 and nothing is found.
    """
    known = samples.where("token != '' and random is not null").select("token", "random")
    moves = known.select("random", F.explode(_places(F.col("token"))).alias("place"))
    rows = moves.groupBy("place").agg(F.count_if("random").alias("random"), F.count_if(~F.col("random")).alias("ordinary")).collect()
    ends = [r for r in rows if r["place"] % _WIDTH == 0]  # each token ends once
    counts = {r["place"]: (r["random"], r["ordinary"]) for r in rows}
    n_random, n_ordinary = (sum(r[kind] for r in ends) for kind in ("random", "ordinary"))
    if not n_random or not n_ordinary:
        return Model([0.0] * _WIDTH * _WIDTH, math.inf)
    ratios: list[float] = []
    for first in range(_WIDTH):
        row = [counts.get(first * _WIDTH + second, (0, 0)) for second in range(_WIDTH)]
        totals = [sum(c[k] for c in row) + SMOOTHING * SIGNS for k in (0, 1)]
        ratios += [math.log((r + SMOOTHING) / totals[0]) - math.log((o + SMOOTHING) / totals[1]) for r, o in row]
    return Model(ratios, max(0.0, math.log(n_ordinary / n_random)))


def log_ratio(token: Column, model: Model) -> Column:
    """Log-likelihood of a token under the random model less that under the ordinary one."""
    table = F.from_json(F.lit(json.dumps(list(model.ratios))), "array<double>")  # folded to a constant
    start = F.struct(F.lit(0).alias("before"), F.lit(0.0).alias("total"))
    walked = F.aggregate(_signs(token), start, lambda at, sign: F.struct(
        sign.alias("before"), (at["total"] + F.get(table, at["before"] * _WIDTH + sign)).alias("total")))
    return walked["total"]


def _running(sizes: Column, n: Column) -> Column:
    """Running totals of an array of n numbers, by doubling steps: n log n however many matches a text has."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda d: d < n)
    return F.aggregate(steps, sizes, lambda totals, d: F.transform(totals, lambda x, i: x + F.coalesce(F.get(totals, i - d), F.lit(0))))


def _placed(text: Column, found: Column, pattern: str) -> Column:
    """The matches found (leftmost, non-overlapping) with start and end in code points: sizes of what lies between them add up."""
    between = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    ends = _running(F.zip_with(between, found, lambda a, m: F.char_length(a) + F.char_length(m)), F.size(found))
    return F.zip_with(found, ends, lambda m, end: F.struct(m.alias("match"), (end - F.char_length(m)).alias("start"), end.alias("end")))


def secret_spans(docs: DataFrame, model: Model) -> DataFrame:
    """Every row of docs with `kept` (a struct of all its columns) and `spans`: kind, start, end and llr, by start and kind.

    Kinds are assign, access and hex, by pattern, and random, by the models; only the last has a log-likelihood ratio. A
    string may be found by several kinds. Places are code points, ends exclusive. Needs a column text; null and empty texts
    have no spans, equal texts equal ones. Nothing is shuffled.
    """
    text = F.col("text")
    rows = docs.select(F.struct("*").alias("kept"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    token = f"{TOKEN}{{{MIN_TOKEN},}}"
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "random": token}
    # Columns of their own, so that each pattern goes over a text once; texts without matches aren't split.
    rows = rows.withColumns({kind: F.regexp_extract_all(text, F.lit(p), F.lit(0)) for kind, p in patterns.items()})

    def spans(place: int, kind: str) -> Column:
        found = F.when(F.size(kind) > 0, _placed(text, F.col(kind), patterns[kind]))
        if kind == "assign":
            found = F.filter(found, lambda m: F.char_length(F.regexp_extract(m["match"], ASSIGN, 2)) >= MIN_VALUE)
        made = F.transform(found, lambda m: F.struct(
            m["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), m["end"].alias("end"),
            (log_ratio(m["match"], model) if kind == "random" else F.lit(None).cast("double")).alias("llr")))
        if kind == "random":
            made = F.filter(made, lambda s: s["llr"] > model.threshold)
        return F.coalesce(made, F.array().cast(_FOUND))

    # An array's items sort by their fields in order: by start, then kind as listed.
    listed = F.array_sort(F.concat(*[spans(k, kind) for k, kind in enumerate(patterns)]))
    return rows.select("kept", F.transform(listed, lambda s: F.struct(*[s[name].alias(name) for name in ("kind", "start", "end", "llr")])).alias("spans"))
