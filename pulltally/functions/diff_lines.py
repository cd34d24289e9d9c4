"""Tests on the lines of a diff.

Case is ignored for ASCII letters only. Texts are lowered once (``fold``) and then
searched for plain substrings, which is several times faster than
case-insensitive patterns over every character.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from pulltally import fixed_values as fixed

# The two characters outside ASCII whose small forms hold ASCII letters: the
# Kelvin sign and the dotted capital I.
FALSE_ASCII = ("\u212a", "\u0130")
NO_LETTER = "\ufffd"


def fold(text: Column) -> Column:
    """``text`` in small letters, for the tests below."""
    for character in FALSE_ASCII:
        text = F.replace(text, F.lit(character), F.lit(NO_LETTER))
    return F.lower(text)


def _any_of(line: Column, words: tuple[str, ...]) -> Column:
    return reduce(or_, [line.contains(word) for word in words])


def is_added(line: Column) -> Column:
    """An added line. File headers (``+++ b/path``) count as well."""
    return line.startswith(fixed.ADDED_LINE_MARK)


def is_test(folded: Column) -> Column:
    return _any_of(folded, fixed.TEST_WORDS)


def is_documentation(folded: Column) -> Column:
    # The pattern is tried only on lines that hold all its parts.
    comment = folded.contains("#") & _any_of(folded, fixed.DOC_COMMENT_WORDS)
    return _any_of(folded, fixed.DOC_WORDS) | (comment & folded.rlike(fixed.DOC_COMMENT_PATTERN))


def is_security(folded: Column) -> Column:
    return _any_of(folded, fixed.SECURITY_WORDS)


LINE_TESTS = {
    "test_additions": is_test,
    "doc_additions": is_documentation,
    "security_pattern_matches": is_security,
}


def added_lines(diff: Column) -> Column:
    """The added lines of a whole diff, folded."""
    return F.filter(F.split(fold(diff), "\n", -1), is_added)
