"""Choosing pull requests: by author and repository, newest, largest, open, recent."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulltally import fixed_values as fixed
from pulltally.functions.moments import Moment, cutoff
from pulltally.functions.prs import pr_size
from pulltally.operators.activity import AUTHOR, newest_first, newest_levels, numbered_place
from pulltally.operators.ranking import SMALL_N, Level, first_of_all, first_rows, ranked

RANK = "selection_rank"


def search(
    prs: DataFrame, author: str | None = None, repo: str | None = None, limit: int | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Pull requests of one author and one repository. Without ``limit`` all of them.

    ``limit`` keeps the newest so many of all, or with ``keys`` of each group.
    """
    if author is not None:
        prs = prs.filter(F.col("author") == author)
    if repo is not None:
        prs = prs.filter(F.col("repo") == repo)
    if limit is None:
        return prs
    if keys:
        return _take(prs, keys, newest_first(), newest_levels(), limit).drop(RANK)
    if limit <= SMALL_N:
        return prs.orderBy(*newest_first()).limit(limit)
    return first_of_all(prs, newest_first(), _minutes(), limit)


def _minutes() -> list[Level]:
    """Buckets for the newest of all: years, hours and minutes, then as in ``newest_levels``."""
    hour, untimed = newest_levels()
    never = F.lit("0001-01-01").cast("timestamp")
    year, minute = (F.coalesce(F.date_trunc(unit, "created_at"), never) for unit in ("year", "minute"))
    return [Level(year, True), hour, Level(minute, True), untimed]


@dataclass(frozen=True)
class Criterion:
    """A parsed selection text. ``count`` below 0 means all but the last so many."""

    kind: str
    count: int | None = None

    @property
    def bound(self) -> int | None:
        """The most pull requests one author can get, if there is such a number."""
        return self.count if self.count is not None and self.count > 0 else None


def parse_criteria(criteria: str) -> Criterion:
    """Read a selection text. Unknown texts mean the newest five."""
    for kind in ("last", "largest"):
        if criteria.startswith(kind + " "):
            return Criterion(kind, _leading_integer(criteria.split(" ")[1]) or fixed.DEFAULT_SELECTION)
    if criteria == "unreviewed":
        return Criterion("unreviewed", fixed.UNREVIEWED_SELECTION)
    if criteria == "open" or criteria in fixed.SELECTION_WINDOW_DAYS:
        return Criterion(criteria)
    return Criterion("last", fixed.DEFAULT_SELECTION)


def _leading_integer(text: str) -> int:
    """The integer a text starts with, hexadecimal after ``0x``; 0 when there is none."""
    found = re.match(r"\s*([+-]?)(?:0[xX]([0-9a-fA-F]+)|([0-9]+))", text)
    if found is None:
        return 0
    sign, hexadecimal, decimal = found.groups()
    value = int(hexadecimal, 16) if hexadecimal else int(decimal)
    return -value if sign == "-" else value


def largest_first() -> list[Column]:
    """Size order, largest first, with repository and number to settle ties."""
    size = pr_size(F.col("additions"), F.col("deletions"))
    return [size.desc(), F.col("repo").asc(), F.col("number").asc()]


def _largest_levels() -> list[Level]:
    """Buckets for ``largest_first``: the size, then the repository and ten thousand numbers of it."""
    return [Level(pr_size(F.col("additions"), F.col("deletions")), True), Level(numbered_place(), False)]


def select_prs(
    prs: DataFrame, criteria: str, as_of: Moment = None, keys: Sequence[str] = AUTHOR
) -> DataFrame:
    """The pull requests each author's report looks at.

    ``last N``, ``largest N``, ``unreviewed`` and the default add ``selection_rank``.
    ``largest`` needs ``additions`` and ``deletions``; pull requests without a size
    are no candidates.
    """
    chosen = parse_criteria(criteria)
    if chosen.kind in fixed.SELECTION_WINDOW_DAYS:
        days = fixed.SELECTION_WINDOW_DAYS[chosen.kind]
        return prs.filter(F.col("created_at") >= cutoff(prs, "created_at", as_of, days))
    if chosen.kind == "open":
        return prs.filter(F.col("state") == "OPEN")
    if chosen.kind == "largest":
        sized = prs.filter(F.col("additions").isNotNull())
        return _take(sized, keys, largest_first(), _largest_levels(), chosen.count)
    if chosen.kind == "unreviewed":
        prs = prs.filter(F.col("state") == "OPEN")
    return _take(prs, keys, newest_first(), newest_levels(), chosen.count)


def _take(
    prs: DataFrame, keys: Sequence[str], order: list[Column], levels: list[Level], count: int
) -> DataFrame:
    if 0 < count <= SMALL_N:
        return first_rows(prs, keys, order, count, RANK, spread=("repo", "number"))
    if count > 0:
        return ranked(prs, keys, order, levels, RANK, first=count)
    return ranked(prs, keys, order, levels, RANK, without_last=-count)
