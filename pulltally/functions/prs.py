"""Column expressions over one pull request."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulltally import fixed_values as fixed


def repo_from_url(url: Column) -> Column:
    """``owner/repo`` of an API repository address; only the first prefix goes."""
    prefix = F.lit(fixed.API_REPO_PREFIX)
    at = F.instr(url, prefix)
    cut = F.concat(F.substring(url, F.lit(1), at - 1), F.substr(url, at + F.length(prefix)))
    return F.when(at > 0, cut).otherwise(url)


def text_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def present(value: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(value, F.lit(""))


def pr_state(state: Column, merged_at: Column) -> Column:
    """``MERGED`` when a merge time is given, else the raw state in capitals."""
    merged = present(merged_at.cast("string")).isNotNull()
    return F.when(merged, F.lit("MERGED")).otherwise(F.upper(state))


def author_or_unknown(login: Column) -> Column:
    return F.coalesce(present(login), F.lit(fixed.UNKNOWN_AUTHOR))


def label_names(labels: Column) -> Column:
    """Labels, each a plain name or a JSON object, as ``ARRAY<STRUCT<name>>``."""

    def name(label: Column) -> Column:
        named = F.coalesce(F.get_json_object(label, "$.name"), F.lit(""))
        return F.struct(F.when(label.startswith("{"), named).otherwise(text_or_empty(label)).alias("name"))

    return F.transform(labels, name)


def utc_timestamp(text: Column) -> Column:
    """An ISO-8601 text as TIMESTAMP; null when it is not one."""
    return present(text).try_cast("timestamp")


def repo_owner(repo: Column) -> Column:
    return F.split_part(repo, F.lit("/"), F.lit(1))


def repo_name(repo: Column) -> Column:
    return F.split_part(repo, F.lit("/"), F.lit(2))


def pr_key(repo: Column, number: Column) -> Column:
    """``owner/repo#number``"""
    return F.concat(repo, F.lit("#"), number.cast("string"))


def key_from_url(url: Column) -> tuple[Column, Column]:
    """Repository and number from a pull request's web address."""
    pattern = r"([^/]+/[^/]+)/pull/(\d+)"
    number = present(F.regexp_extract(url, pattern, 2)).cast("bigint")
    return present(F.regexp_extract(url, pattern, 1)), number


def month_key(utc_time: Column) -> Column:
    """The month of a time without zone, as ``moments.in_utc`` gives it; independent of the session's zone."""
    return F.substring(utc_time.cast("string"), 1, 7)


def pr_size(additions: Column, deletions: Column) -> Column:
    """Changed lines; a missing count is 0."""
    return F.coalesce(additions, F.lit(0)) + F.coalesce(deletions, F.lit(0))


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 where ``whole`` is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))
