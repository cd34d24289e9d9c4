"""Column layouts of the tables the operators exchange, and of the raw exports."""

from __future__ import annotations

PR_KEY = ("repo", "number")

PULL_REQUESTS = (
    "repo STRING, number BIGINT, state STRING, title STRING, body STRING, "
    "created_at TIMESTAMP, closed_at TIMESTAMP, merged_at TIMESTAMP, author STRING, "
    "additions BIGINT, deletions BIGINT, changed_files BIGINT, "
    "labels ARRAY<STRUCT<name: STRING>>, url STRING"
)

PR_DETAILS = (
    "repo STRING, number BIGINT, url STRING, body STRING, created_at TIMESTAMP, "
    "closed_at TIMESTAMP, additions BIGINT, deletions BIGINT, changed_files BIGINT, "
    "author STRING, assignees ARRAY<STRUCT<login: STRING>>, "
    "labels ARRAY<STRUCT<name: STRING>>, head_ref_name STRING, base_ref_name STRING, "
    "is_draft BOOLEAN"
)

PR_DIFFS = "repo STRING, number BIGINT, diff STRING"

# A diff of any size as chunks of its bytes, numbered in their order.
PR_DIFF_CHUNKS = "repo STRING, number BIGINT, chunk BIGINT, data BINARY"

# Exported diff files and their sizes.
DIFF_MANIFEST = "path STRING, bytes BIGINT"

PR_FILES = (
    "repo STRING, number BIGINT, path STRING, additions BIGINT, deletions BIGINT, "
    "change_type STRING"
)

PR_METRICS = (
    "repo STRING, number BIGINT, test_additions BIGINT, doc_additions BIGINT, "
    "security_pattern_matches BIGINT, total_additions BIGINT, total_deletions BIGINT, "
    "files_changed BIGINT"
)

METRIC_COLUMNS = (
    "test_additions",
    "doc_additions",
    "security_pattern_matches",
    "total_additions",
    "total_deletions",
    "files_changed",
)

# Labels are read as strings: Spark keeps a nested object as its JSON text, so
# one array may mix plain names and objects.
RAW_API_ITEM = (
    "number BIGINT, state STRING, title STRING, body STRING, created_at STRING, "
    "closed_at STRING, repository_url STRING, user STRUCT<login: STRING>, "
    "labels ARRAY<STRING>, pull_request STRUCT<merged_at: STRING>, html_url STRING"
)

RAW_CLI_RECORD = (
    "repository STRUCT<nameWithOwner: STRING>, number BIGINT, state STRING, title STRING, "
    "body STRING, createdAt STRING, closedAt STRING, author STRUCT<login: STRING>, "
    "labels ARRAY<STRING>, url STRING"
)

RAW_MERGE_STATUS = "repo STRING, number BIGINT, state STRING, mergedAt STRING"

RAW_API_DETAIL = (
    "html_url STRING, body STRING, created_at STRING, closed_at STRING, additions BIGINT, "
    "deletions BIGINT, changed_files BIGINT, user STRUCT<login: STRING>, "
    "assignees ARRAY<STRUCT<login: STRING>>, labels ARRAY<STRING>, "
    "head STRUCT<ref: STRING>, base STRUCT<ref: STRING>, draft BOOLEAN"
)

RAW_CLI_DETAIL = (
    "url STRING, body STRING, createdAt STRING, closedAt STRING, additions BIGINT, "
    "deletions BIGINT, changedFiles BIGINT, author STRUCT<login: STRING>, "
    "assignees ARRAY<STRUCT<login: STRING>>, labels ARRAY<STRING>, "
    "headRefName STRING, baseRefName STRING, isDraft BOOLEAN"
)

RAW_FILES = (
    "repo STRING, number BIGINT, files ARRAY<STRUCT<path: STRING, filename: STRING, "
    "additions: BIGINT, deletions: BIGINT, changeType: STRING, status: STRING>>"
)

RESPONSE = "insights: ARRAY<STRING>, recommendations: ARRAY<STRING>"

_WINDOW = "STRUCT<total_prs: BIGINT, merged_prs: BIGINT, merge_rate: STRING>"

SUMMARY = (
    "STRUCT<total_prs: BIGINT, open_prs: BIGINT, closed_prs: BIGINT, merged_prs: BIGINT, "
    f"merge_rate: STRING, last_30_days: {_WINDOW}, last_90_days: {_WINDOW}>"
)

# What the texts need of an activity report.
REPORT_COLUMNS = {
    "summary": SUMMARY,
    "repositories": "ARRAY<STRUCT<repo: STRING, count: BIGINT>>",
    "monthly_activity": "ARRAY<STRUCT<month: STRING, count: BIGINT>>",
}

# The report document as it is stored, with the names its readers know.
REPORT_DOCUMENT = (
    "user STRING, part BIGINT, generatedAt STRING, "
    "summary STRUCT<totalPRs: BIGINT, openPRs: BIGINT, closedPRs: BIGINT, mergedPRs: BIGINT, "
    "mergeRate: STRING, last30Days: STRUCT<totalPRs: BIGINT, mergedPRs: BIGINT, mergeRate: STRING>, "
    "last90Days: STRUCT<totalPRs: BIGINT, mergedPRs: BIGINT, mergeRate: STRING>>, "
    "repositories ARRAY<STRUCT<repo: STRING, count: BIGINT>>, "
    "monthlyActivity ARRAY<STRUCT<month: STRING, count: BIGINT>>, "
    "recentPRs ARRAY<STRUCT<repo: STRING, number: BIGINT, title: STRING, state: STRING, createdAt: STRING>>"
)
