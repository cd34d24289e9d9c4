from __future__ import annotations

import math
import random
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from pulltally.functions import prs, text
from pulltally.functions.moments import iso_text, report_date, run_name, short_date


def exact(x: float, digits: int) -> str:
    """Nearest by the exact binary value, upwards at a tie."""
    step = Decimal(1).scaleb(-digits)
    return str(Decimal(x).quantize(step, ROUND_HALF_UP))


def values() -> list[float]:
    random.seed(7)
    found = [m / n * 100 for n in range(1, 161) for m in range(n + 1)]
    found += [k / 20 for k in range(4001)] + [random.random() * 100 for _ in range(5000)]
    found += [math.nextafter(k / 20, side) for k in range(1, 4001) for side in (0.0, math.inf)]
    return found


def test_one_decimal_is_exact(spark):
    given = values()
    df = spark.createDataFrame([(x,) for x in given], "x DOUBLE")
    rows = df.select("x", text.fixed_one(F.col("x")).alias("t"), text.fixed_zero(F.col("x")).alias("z")).collect()
    assert len(rows) == len(given)
    assert [r for r in rows if r.t != exact(r.x, 1)] == []
    assert [r for r in rows if r.z != exact(r.x, 0)] == []


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_rates(spark):
    assert one(spark, text.rate_text(F.lit(0), F.lit(0))) == "0"
    assert one(spark, text.rate_text(F.lit(0), F.lit(3))) == "0.0"
    assert one(spark, text.rate_text(F.lit(23), F.lit(80))) == "28.7"
    assert one(spark, text.rate_short(F.lit("50.0"))) == "50"
    assert one(spark, text.rate_short(F.lit("83.3"))) == "83.3"
    assert one(spark, text.rate_short(F.lit(None).cast("string"))) == "0"
    assert one(spark, text.rate_number(F.lit(None).cast("string"))) == 0.0


def test_not_available(spark):
    assert one(spark, text.or_not_available(F.lit(0))) == "N/A"
    assert one(spark, text.or_not_available(F.lit(None).cast("bigint"))) == "N/A"
    assert one(spark, text.or_not_available(F.lit(7))) == "7"
    assert one(spark, text.or_text(F.lit("0"), "N/A")) == "0"
    assert one(spark, text.or_text(F.lit(""), "N/A")) == "N/A"


def test_fences(spark):
    fenced = "\n```JSON  \n{\"a\": 1}\n```\n\t"
    assert one(spark, text.strip_fences(F.lit(fenced))) == '{"a": 1}'
    assert one(spark, text.strip_fences(F.lit(" plain ")))  == "plain"


def test_pull_request_expressions(spark):
    url = "https://api.github.com/repos/test/repo"
    assert one(spark, prs.repo_from_url(F.lit(url))) == "test/repo"
    assert one(spark, prs.repo_from_url(F.lit("other/place"))) == "other/place"
    assert one(spark, prs.repo_from_url(F.lit("x-" + url + "/" + url))) == "x-test/repo/" + url
    assert one(spark, prs.pr_state(F.lit("closed"), F.lit("2025-01-02T00:00:00Z"))) == "MERGED"
    assert one(spark, prs.pr_state(F.lit("closed"), F.lit(""))) == "CLOSED"
    assert one(spark, prs.pr_state(F.lit("open"), F.lit(None).cast("string"))) == "OPEN"
    assert one(spark, prs.author_or_unknown(F.lit(""))) == "unknown"
    labels = F.array(F.lit("a"), F.lit('{"name":"b"}'), F.lit('{"id":1}'), F.lit(None).cast("string"))
    assert [x["name"] for x in one(spark, prs.label_names(labels))] == ["a", "b", "", ""]
    assert one(spark, prs.repo_owner(F.lit("own/rep"))) == "own"
    assert one(spark, prs.repo_name(F.lit("own/rep"))) == "rep"
    assert one(spark, prs.pr_key(F.lit("own/rep"), F.lit(3))) == "own/rep#3"
    repo, number = prs.key_from_url(F.lit("https://github.com/test/repo/pull/789"))
    assert (one(spark, repo), one(spark, number)) == ("test/repo", 789)
    assert one(spark, prs.share(F.lit(1), F.lit(0))) == 0.0


def test_moments():
    moment = "2025-01-05T10:30:00.250+00:00"
    assert report_date(moment) == "2025-01-05"
    assert run_name(moment) == "analysis-2025-01-05T10-30-00"
    assert iso_text(moment) == "2025-01-05T10:30:00.250Z"
    assert short_date(moment) == "1/5/2025"
    assert report_date("2025-01-05T23:30:00-02:00") == "2025-01-06"
