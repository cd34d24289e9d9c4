"""Pull requests that touch files of given languages (own definition, by file extension)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulltally import fixed_values as fixed
from pulltally import schema


def extensions_of(languages: str) -> list[str]:
    """Extensions of a comma-separated list of languages; an unknown name counts as an extension."""
    names = [name.strip().lower() for name in languages.split(",")]
    found = {extension for name in names if name for extension in fixed.LANGUAGE_EXTENSIONS.get(name, (name,))}
    return sorted(found)


def language_filter(
    prs: DataFrame, files: DataFrame, languages: str | None, on: Sequence[str] = schema.PR_KEY
) -> DataFrame:
    """The pull requests with at least one file in ``languages``; all of them without any."""
    wanted = extensions_of(languages or "")
    if not wanted:
        return prs
    extension = F.lower(F.regexp_extract("path", r"[.]([^./]+)$", 1))
    return prs.join(files.filter(extension.isin(wanted)).select(*on), list(on), "left_semi")
