"""Small tables the tests share."""

from __future__ import annotations

from datetime import datetime, timezone

PR_COLUMNS = "repo STRING, number BIGINT, state STRING, title STRING, created_at TIMESTAMP, author STRING, additions BIGINT, deletions BIGINT"
METRIC_COLUMNS = (
    "repo STRING, number BIGINT, test_additions BIGINT, doc_additions BIGINT, "
    "security_pattern_matches BIGINT, total_additions BIGINT, total_deletions BIGINT, files_changed BIGINT")


def at(text: str) -> datetime:
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


def pull_requests(spark, rows):
    """Rows of (number, state, created_at text, additions, deletions[, author[, repo]])."""
    full = []
    for number, state, created, additions, deletions, *rest in rows:
        author, repo = (list(rest) + ["dev", "test/repo"][len(rest):])[:2]
        full.append((repo, number, state, f"PR {number}", at(created), author, additions, deletions))
    return spark.createDataFrame(full, PR_COLUMNS)


def three(spark):
    return pull_requests(spark, [
        (1, "OPEN", "2025-01-15T10:00:00", 100, 50),
        (2, "MERGED", "2025-01-14T10:00:00", 200, 100),
        (3, "CLOSED", "2025-01-13T10:00:00", 50, 25),
    ])


def metrics(spark, rows):
    return spark.createDataFrame([("test/repo", *row) for row in rows], METRIC_COLUMNS)


# Added test lines: `latest`, the spec file. Documentation: TODO comment, README, `///`. Security: `author`, `api_key`.
DIFF = (
    "diff --git a/lib/orders.py b/lib/orders.py\n"
    "+++ b/lib/orders.py\n"
    "@@ -1,3 +1,4 @@\n"
    " import math\n"
    "-latest = None  # TODO\n"
    "+latest = newer(rows)\r\n"
    "+# TODO: tell the author\n"
    "+total = math.fsum(rows)\n"
    "-password = ''\n"
    "+++ b/checks/orders.spec.ts\n"
    "+it('adds up')\n"
    "+++ b/README.md\n"
    "+Fixme later\n"
    "+/// FIXME api_key is read here\n"
)
DIFF_COUNTS = (2, 3, 2)
