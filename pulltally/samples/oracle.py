"""The sample queries once more as DuckDB SQL, written from the definitions and not from the Spark code."""

from __future__ import annotations

from pulltally import fixed_values as fixed

AS_OF = "TIMESTAMP '2001-08-02'"
NL = "chr(10)"

# Building blocks, each usable as a CTE. ------------------------------------

PRS = """prs AS (
  SELECT o_orderkey AS number, concat('user-', o_custkey) AS author,
         concat('org/repo-', substr(o_orderpriority, 1, 1)) AS repo,
         CASE o_orderstatus WHEN 'F' THEN 'MERGED' WHEN 'O' THEN 'OPEN' ELSE 'CLOSED' END AS state,
         o_orderdate AS created_at, concat('PR ', o_orderkey) AS title
  FROM orders)"""

DETAILS = """details AS (
  SELECT l_orderkey AS number,
         CAST(floor(sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END)
           * max(CASE WHEN l_orderkey % 3 = 0 THEN 20 ELSE 1 END)
           / max(CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 20 END)) AS BIGINT) AS additions,
         CAST(floor(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)
           * max(CASE WHEN l_orderkey % 3 = 0 THEN 20 ELSE 1 END)
           / max(CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE 20 END)) AS BIGINT) AS deletions,
         count(*) AS changed_files
  FROM lineitem GROUP BY l_orderkey)"""

DIFFS = """held AS (SELECT count(*) AS n FROM documents),
diffs AS (
  SELECT o_orderkey AS number, CASE WHEN o_orderkey % 29 = 0 THEN '' ELSE array_to_string(list_concat(
           [concat('+++ b/', CASE o_orderkey % 5 WHEN 0 THEN 'src/app.py' WHEN 1 THEN 'tests/app.test.ts'
              WHEN 2 THEN 'README.md' WHEN 3 THEN 'src/auth.ts' ELSE 'src/core.go' END)],
           list_transform(string_split(text, chr(10)), lambda l, i:
             concat(CASE WHEN (i - 1) % 3 = 2 THEN '-' ELSE '+' END, l))), chr(10)) END AS diff
  FROM orders, held, documents
  WHERE doc_id = o_orderkey % (n + n // 16))"""


def _matching(pattern: str) -> str:
    return (f"len(list_filter(string_split(diff, chr(10)), lambda l: "
            f"starts_with(l, '+') AND regexp_matches(l, '(?i){pattern}')))")


# The line tests as patterns, matched in any case.
TEST_PATTERN = r"test|[.]spec[.]"
DOC_PATTERN = r"README|[.]md|/[*][*]|///|#[^\n\r\x{2028}\x{2029}]*(?:TODO|FIXME)"
SECURITY_PATTERN = r"password|secret|token|api_key|private_key|auth"

COUNTS = f"""counts AS (
  SELECT number, {_matching(TEST_PATTERN)} AS test_additions,
         {_matching(DOC_PATTERN)} AS doc_additions,
         {_matching(SECURITY_PATTERN)} AS security_pattern_matches
  FROM diffs)"""

METRICS = """metrics AS (
  SELECT number, test_additions, doc_additions, security_pattern_matches,
         additions AS total_additions, deletions AS total_deletions, changed_files AS files_changed
  FROM details JOIN counts USING (number))"""

NEWEST = "created_at DESC, repo, number"


def _selected(condition: str) -> str:
    return f"selected AS (SELECT * FROM prs {condition})"


LAST_10 = _selected(f"QUALIFY row_number() OVER (PARTITION BY author ORDER BY {NEWEST}) <= 10")

ROLLUP = """base AS (SELECT DISTINCT author FROM {authors}),
joined AS (
  SELECT s.author, s.state, m.*, coalesce(total_additions, 0) + coalesce(total_deletions, 0) AS size
  FROM selected s LEFT JOIN metrics m USING (number)),
sums AS (
  SELECT author, count(*) AS total_prs, count(*) FILTER (state = 'MERGED') AS merged_prs,
         sum(size) AS total_size, count(*) FILTER (size > 1000) AS large_prs,
         count(total_additions) AS metric_prs, sum(total_additions) AS total_additions,
         sum(total_deletions) AS total_deletions, sum(test_additions) AS total_test_additions,
         sum(doc_additions) AS total_doc_additions, count(*) FILTER (security_pattern_matches > 0) AS security_prs,
         CAST(sum(CAST(CASE WHEN total_additions > 0 THEN test_additions / total_additions ELSE 0 END
                       AS DECIMAL(28, 12))) AS DOUBLE) AS test_shares,
         CAST(sum(CAST(CASE WHEN total_additions > 0 THEN doc_additions / total_additions ELSE 0 END
                       AS DECIMAL(28, 12))) AS DOUBLE) AS doc_shares
  FROM joined GROUP BY author),
whole AS (
  SELECT author, {zeros}
  FROM base LEFT JOIN sums USING (author)),
rollup AS (
  SELECT author, total_prs, merged_prs, total_size, large_prs, metric_prs, total_additions, total_deletions,
         total_test_additions, total_doc_additions, security_prs,
         CASE WHEN total_prs > 0 THEN merged_prs / total_prs * 100 ELSE 0 END AS merge_rate,
         CASE WHEN total_prs > 0 THEN total_size / total_prs ELSE 0 END AS average_pr_size,
         CASE WHEN total_additions > 0 THEN total_test_additions / total_additions * 100 ELSE 0 END AS test_to_code_ratio,
         CASE WHEN metric_prs > 0 THEN test_shares / metric_prs END AS average_test_ratio,
         doc_shares / greatest(metric_prs, 1) AS average_doc_ratio,
         total_doc_additions / greatest(total_additions, 1) * 100 AS documentation_percent
  FROM whole)"""

_COUNTERS = ("total_prs", "merged_prs", "total_size", "large_prs", "metric_prs", "total_additions", "total_deletions",
             "total_test_additions", "total_doc_additions", "security_prs")


def _rollup(authors: str = "selected") -> str:
    zeros = ", ".join(
        [f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in _COUNTERS]
        + [f"coalesce({c}, 0) AS {c}" for c in ("test_shares", "doc_shares")])
    return ROLLUP.format(authors=authors, zeros=zeros)


def _one(x: str) -> str:
    """One decimal. printf rounds exactly but ties to even; only quarters can be ties, and go up."""
    return f"printf('%.1f', ({x}) + CASE WHEN ({x}) * 4 = floor(({x}) * 4) THEN 0.01::DOUBLE ELSE 0 END)"


def _rate(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN {_one(f'{part} / {whole} * 100')} ELSE '0' END"


def _summary(key: str = "author") -> str:
    return f"""summary AS (
  SELECT *, {_rate('merged_prs', 'total_prs')} AS merge_rate,
         {_rate('merged_30d', 'total_30d')} AS merge_rate_30d,
         {_rate('merged_90d', 'total_90d')} AS merge_rate_90d
  FROM (SELECT {key}, count(*) AS total_prs, count(*) FILTER (state = 'OPEN') AS open_prs,
               count(*) FILTER (state = 'CLOSED') AS closed_prs, count(*) FILTER (state = 'MERGED') AS merged_prs,
               count(*) FILTER (created_at > {AS_OF} - INTERVAL 30 DAY) AS total_30d,
               count(*) FILTER (created_at > {AS_OF} - INTERVAL 30 DAY AND state = 'MERGED') AS merged_30d,
               count(*) FILTER (created_at > {AS_OF} - INTERVAL 90 DAY) AS total_90d,
               count(*) FILTER (created_at > {AS_OF} - INTERVAL 90 DAY AND state = 'MERGED') AS merged_90d
        FROM prs GROUP BY {key}))"""


REPOS = """repos AS (
  SELECT *, row_number() OVER (PARTITION BY author ORDER BY pr_count DESC, last_created_at DESC, repo) AS repo_rank
  FROM (SELECT author, repo, count(*) AS pr_count, max(created_at) AS last_created_at FROM prs GROUP BY author, repo))"""

MONTHS = """months AS (
  SELECT *, row_number() OVER (PARTITION BY author ORDER BY month DESC) AS month_rank
  FROM (SELECT author, strftime(created_at, '%Y-%m') AS month, count(*) AS pr_count FROM prs GROUP BY author, month))"""

RECENT = f"""recent AS (
  SELECT author, repo, number, title, state, created_at,
         row_number() OVER (PARTITION BY author ORDER BY {NEWEST}) AS recent_rank
  FROM prs QUALIFY recent_rank <= 30)"""

# Rules: position, condition, finding, recommendation, risk level and text.
_RULES = [
    ("merge_rate < 50", f"concat('Low merge rate detected: ', {_one('merge_rate')}, '%')",
     fixed.LOW_MERGE_ADVICE, fixed.LOW_MERGE_RISK),
    ("average_test_ratio < 0.2::DOUBLE",
     f"concat('Low test coverage: ', {_one('average_test_ratio * 100')}, '% average test-to-code ratio')",
     fixed.LOW_TEST_ADVICE, fixed.LOW_TEST_RISK),
    ("large_prs > total_prs * 0.3::DOUBLE", "concat(large_prs, ' PRs exceed 1000 changes')",
     fixed.LARGE_PR_ADVICE, fixed.LARGE_PR_RISK),
    ("average_doc_ratio < 0.05::DOUBLE", f"'{fixed.LOW_DOC_FINDING}'", fixed.LOW_DOC_ADVICE, None),
    ("security_prs > 0", "concat(security_prs, ' PRs contain potential security-sensitive changes')",
     fixed.SECURITY_ADVICE, None),
]

FINDINGS = "fired AS (" + "\nUNION ALL ".join(
    f"SELECT author, {i} AS rule, {finding} AS finding, '{advice}' AS advice, "
    + (f"'{risk[0]}' AS level, '{risk[1]}' AS description" if risk else "NULL AS level, NULL AS description")
    + f" FROM rollup WHERE {condition}"
    for i, (condition, finding, advice, risk) in enumerate(_RULES)) + ")"

_SHORT_30 = "regexp_replace(merge_rate_30d, '\\.0$', '')"
_SHORT_90 = "regexp_replace(merge_rate_90d, '\\.0$', '')"
_N30, _N90 = "CAST(merge_rate_30d AS DOUBLE)", "CAST(merge_rate_90d AS DOUBLE)"

TRENDS = f"""trends AS (
  SELECT author, 10 AS rule, concat('Merge rate declining: ', {_SHORT_30}, '% (30d) vs ', {_SHORT_90}, '% (90d)') AS finding
  FROM summary WHERE {_N30} < {_N90} - 10
  UNION ALL
  SELECT author, 11, concat('Merge rate improving: ', {_SHORT_30}, '% (30d) vs ', {_SHORT_90}, '% (90d)')
  FROM summary WHERE {_N30} > {_N90} + 10
  UNION ALL
  SELECT author, 12, 'Low activity in the last 30 days' FROM summary WHERE total_30d < 5)"""

LISTS = """found AS (
  SELECT author, string_agg(finding, '|' ORDER BY rule) AS findings
  FROM (SELECT author, rule, finding FROM fired UNION ALL SELECT author, rule, finding FROM trends) GROUP BY author),
advised AS (
  SELECT author, string_agg(advice, '|' ORDER BY rule) AS recommendations,
         string_agg(concat(level, ':', description), '|' ORDER BY rule) FILTER (level IS NOT NULL) AS risks
  FROM fired GROUP BY author),
result AS (
  SELECT r.*, coalesce(findings, '') AS findings, coalesce(recommendations, '') AS recommendations,
         coalesce(risks, '') AS risks
  FROM rollup r LEFT JOIN found USING (author) LEFT JOIN advised USING (author))"""

RESPONSES = """responses AS (
  SELECT author, CASE
      WHEN last IN ('0', '1', '2', '3') THEN answer
      WHEN last IN ('4', '5', '6') THEN concat('```json', chr(10), answer, chr(10), '```', chr(10))
      WHEN last = '7' THEN '{"insights": ["only insights"]}'
      WHEN last = '8' THEN 'Sorry, no analysis today.' END
    || CASE WHEN tens = '3' AND last NOT IN ('7', '8') THEN ' {}' ELSE '' END AS content
  FROM (SELECT DISTINCT author, right(author, 1) AS last, substr(author, -2, 1) AS tens,
               concat('{"insights": ["Insight for ', author, '"], "recommendations": ["Advice A", "Advice B"]}') AS answer
        FROM prs)
  WHERE last <> '9')"""

_ANALYSIS = (PRS, DETAILS, DIFFS, COUNTS, METRICS, LAST_10, _rollup(), FINDINGS, _summary(), TRENDS, LISTS)


def _with(*parts: str, select: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n" + select


def _text(template: str, **values: str) -> str:
    """SQL that fills a fixed text: the template's places become concatenated expressions."""
    import re

    pieces = []
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{") and piece.endswith("}") and piece[1:-1] in values:
            pieces.append(f"({values[piece[1:-1]]})")
        elif piece:
            pieces.append("'" + piece.replace("'", "''") + "'")
    return "concat(" + ", ".join(pieces) + ")"


def _na(value: str) -> str:
    return f"CASE WHEN {value} = 0 THEN 'N/A' ELSE CAST({value} AS VARCHAR) END"


def _per_line(column: str, line: str) -> str:
    """Lines of a '|'-joined list, each written by ``line`` over ``x`` and ``i``; '' for an empty list."""
    return (f"CASE WHEN {column} = '' THEN '' ELSE array_to_string(list_transform(string_split({column}, '|'), "
            f"lambda x, i: {line}), chr(10)) END")


_RISK_LEVEL, _RISK_TEXT = "upper(split_part(x, ':', 1))", "split_part(x, ':', 2)"

_COMMON = dict(
    merge_rate=_one("merge_rate"), test_ratio=_one("test_to_code_ratio"),
    average_size="CAST(CAST(floor(average_pr_size + 0.5::DOUBLE) AS BIGINT) AS VARCHAR)",
    total_prs="total_prs", doc_lines="total_doc_additions",
    additions="total_additions", deletions="total_deletions", date="'2001-08-02'")

INSIGHT = _text(fixed.INSIGHT_PROMPT, **{
    **_COMMON, "review_focus": "'test coverage, security'", "doc_ratio": _one("documentation_percent"),
    "findings": _per_line("findings", "x")})

COACHING = _text(fixed.COACHING_PROMPT, **{
    **_COMMON, "user": "author", "period": "'8/2/2001'",
    "total_prs": "s.total_prs", "merge_rate": "s.merge_rate", "open_prs": "s.open_prs",
    "closed_prs": "s.closed_prs", "merged_prs": "s.merged_prs",
    "test_ratio": _one("r.test_to_code_ratio"),
    "repositories": "repo_lines", "months": "month_lines",
    "findings": _per_line("findings", "x"),
    "risks": _per_line("risks", f"concat('- ', {_RISK_LEVEL}, ': ', {_RISK_TEXT})")})

ASSESSMENT = _text(fixed.ASSESSMENT_REPORT, **{
    **_COMMON, "user": "author", "review_focus": "'test coverage, security'", "criteria": "'last 10'",
    "total_prs": "r.total_prs", "merge_rate": _one("r.merge_rate"), "test_ratio": _one("r.test_to_code_ratio"),
    "total_all": _na("s.total_prs"), "merged_all": _na("s.merged_prs"), "rate_all": "s.merge_rate",
    "total_90": _na("total_90d"), "merged_90": _na("merged_90d"), "rate_90": "merge_rate_90d",
    "total_30": _na("total_30d"), "merged_30": _na("merged_30d"), "rate_30": "merge_rate_30d",
    "findings": _per_line("findings", "concat('- ', x)"),
    "risks": _per_line("risks", f"concat('- **', {_RISK_LEVEL}, '**: ', {_RISK_TEXT})"),
    "recommendations": _per_line("recommendations", "concat(i, '. ', x)"),
    "footer": f"'{fixed.REPORT_FOOTER}'"})


def _select(condition: str, columns: str = "", source: str = "prs", parts: tuple[str, ...] = ()) -> str:
    return _with(PRS, *parts, select=f"SELECT author, repo, number, state, created_at{columns} FROM {source} {condition}")


_RANKED = f", row_number() OVER (PARTITION BY author ORDER BY {NEWEST}) AS selection_rank"
_SIZED = """sized AS (
  SELECT p.*, additions, deletions FROM prs p LEFT JOIN details USING (number))"""
_BY_SIZE = (", additions, deletions, row_number() OVER (PARTITION BY author "
            "ORDER BY coalesce(additions, 0) + coalesce(deletions, 0) DESC, repo, number) AS selection_rank")
_BODY = "CASE WHEN number % 2 = 0 THEN concat('Body of PR ', number) ELSE '' END"
_DONE = "'2001-08-01 12:00:00'"

ORACLE: dict[str, str] = {
    "activity_summary": _with(PRS, _summary(), select="""
SELECT *, round(merged_prs / total_prs * 100, 6) AS merge_rate_value,
       round(CASE WHEN total_30d > 0 THEN merged_30d / total_30d * 100 ELSE 0 END, 6) AS merge_rate_value_30d,
       round(CASE WHEN total_90d > 0 THEN merged_90d / total_90d * 100 ELSE 0 END, 6) AS merge_rate_value_90d
FROM summary"""),
    "repo_activity_summary": _with(PRS, _summary("repo"), select="SELECT * FROM summary"),
    "repo_counts": _with(PRS, REPOS, select="SELECT * FROM repos"),
    "top_repositories": _with(PRS, REPOS, select="SELECT * FROM repos WHERE repo_rank <= 3"),
    "monthly_counts": _with(PRS, MONTHS, select="SELECT * FROM months"),
    "latest_months": _with(PRS, MONTHS, select="SELECT * FROM months WHERE month_rank <= 3"),
    "recent_prs": _with(PRS, RECENT, select="SELECT * FROM recent"),
    "activity_report": _with(PRS, _summary(), REPOS, MONTHS, RECENT, select="""
SELECT author, CAST(0 AS BIGINT) AS part, '2001-08-02T00:00:00.000Z' AS generated_at,
       total_prs, open_prs, closed_prs, merged_prs, merge_rate,
       total_30d AS total_prs_30d, merged_30d AS merged_prs_30d, merge_rate_30d,
       total_90d AS total_prs_90d, merged_90d AS merged_prs_90d, merge_rate_90d,
       repositories, monthly_activity, recent_prs
FROM summary
JOIN (SELECT author, string_agg(concat_ws(':', repo, pr_count), ' ' ORDER BY repo_rank) AS repositories
      FROM repos GROUP BY author) USING (author)
JOIN (SELECT author, string_agg(concat_ws(':', month, pr_count), ' ' ORDER BY month_rank) AS monthly_activity
      FROM months GROUP BY author) USING (author)
JOIN (SELECT author, string_agg(concat_ws(':', repo, number, title, state), ' ' ORDER BY recent_rank) AS recent_prs
      FROM recent GROUP BY author) USING (author)"""),
    "bundle_documents": _with(PRS, DETAILS, DIFFS, COUNTS, METRICS, f"""placed AS (
  SELECT *, row_number() OVER (PARTITION BY author ORDER BY {NEWEST}) AS place FROM prs QUALIFY place <= 10)""", select="""
SELECT author AS user, CAST(0 AS BIGINT) AS part, 'last 10' AS selection,
       string_agg(concat(repo, '#', number, '@', strftime(created_at, '%Y-%m-%dT%H:%M:%SZ')), ' ' ORDER BY place) AS selected,
       count(total_additions) AS measured, CAST(coalesce(sum(test_additions), 0) AS BIGINT) AS test_lines,
       count(*) AS total_prs, CAST(coalesce(sum(total_additions), 0) AS BIGINT) AS additions
FROM placed LEFT JOIN metrics USING (number) GROUP BY author"""),
    "pr_fields": _with(PRS, DETAILS, _SIZED, select=f"""
SELECT number, 'org' AS owner, substr(repo, 5) AS name, concat(repo, '#', number) AS key,
       strftime(created_at, '%Y-%m') AS month, coalesce(additions, 0) + coalesce(deletions, 0) AS size,
       {_one('CASE WHEN additions > 0 THEN deletions / additions * 100 ELSE 0 END')} AS deleted_percent
FROM sized"""),
    "cli_pr_details": _with(PRS, DETAILS, select="""
SELECT repo, number, title AS body, additions, deletions, changed_files, author, author AS assignee,
       'feature' AS head_ref_name, state = 'OPEN' AS is_draft
FROM prs JOIN details USING (number)"""),
    "search_author_repo": _with(PRS, select="SELECT * FROM prs WHERE author = 'user-1' AND repo = 'org/repo-1'"),
    "search_newest_per_author": _with(PRS, select=f"""
SELECT * FROM prs QUALIFY row_number() OVER (PARTITION BY author ORDER BY {NEWEST}) <= 4"""),
    "search_newest": _with(PRS, select=f"SELECT * FROM prs ORDER BY {NEWEST} LIMIT 100"),
    "search_newest_many": _with(PRS, select=f"SELECT * FROM prs ORDER BY {NEWEST} LIMIT 1234"),
    "select_last_n": _select("QUALIFY selection_rank <= 3", _RANKED),
    "select_last_many": _select("QUALIFY selection_rank <= 2000", _RANKED),
    "select_last_negative": _select("QUALIFY selection_rank <= count(*) OVER (PARTITION BY author) - 3", _RANKED),
    "select_largest_n": _select("WHERE additions IS NOT NULL QUALIFY selection_rank <= 3", _BY_SIZE, "sized",
                                (DETAILS, _SIZED)),
    "select_largest_negative": _select(
        "WHERE additions IS NOT NULL QUALIFY selection_rank <= count(*) OVER (PARTITION BY author) - 2",
        _BY_SIZE, "sized", (DETAILS, _SIZED)),
    "select_unreviewed": _select("WHERE state = 'OPEN' QUALIFY selection_rank <= 10", _RANKED),
    "select_last_week": _select(f"WHERE created_at >= {AS_OF} - INTERVAL 7 DAY"),
    "select_last_30d": _select(f"WHERE created_at >= {AS_OF} - INTERVAL 30 DAY"),
    "select_last_90d": _select(f"WHERE created_at >= {AS_OF} - INTERVAL 90 DAY"),
    "select_open": _select("WHERE state = 'OPEN'"),
    "select_default": _select("QUALIFY selection_rank <= 5", _RANKED),
    "diff_line_counts": _with(DIFFS, COUNTS, select="SELECT * FROM counts"),
    "diff_chunk_counts": _with(DIFFS, COUNTS, select="SELECT * FROM counts"),
    "diff_records": _with(DIFFS, COUNTS, select="SELECT * FROM counts WHERE number % 13 <> 0 AND number % 17 <> 0"),
    "diff_records_rejected": _with(DIFFS, select="""
SELECT number, 'export.json' AS file, CASE WHEN number % 13 = 0 THEN 'not JSON' ELSE 'no diff' END AS reason
FROM diffs WHERE number % 13 = 0 OR number % 17 = 0"""),
    "diff_files": _with(DIFFS, select="""
SELECT concat('org/re po-', number % 7) AS repo, number, length(diff) AS length FROM diffs"""),
    "diff_line_counts_by_line": _with(DIFFS, COUNTS, select="SELECT * FROM counts"),
    "pr_metrics": _with(DETAILS, DIFFS, COUNTS, METRICS, select="SELECT * FROM metrics"),
    "selected_pr_metrics": _with(PRS, DETAILS, DIFFS, COUNTS, METRICS, LAST_10, select="""
SELECT * FROM metrics WHERE number IN (SELECT number FROM selected)"""),
    "analysis_metrics": _with(PRS, DETAILS, DIFFS, COUNTS, METRICS, LAST_10, _rollup(), select="""
SELECT * REPLACE (round(merge_rate, 6) AS merge_rate, round(average_pr_size, 6) AS average_pr_size,
                  round(test_to_code_ratio, 6) AS test_to_code_ratio, round(average_test_ratio, 6) AS average_test_ratio,
                  round(average_doc_ratio, 6) AS average_doc_ratio,
                  round(documentation_percent, 6) AS documentation_percent)
FROM rollup"""),
    "largest_analysis_metrics": _with(
        PRS, DETAILS, DIFFS, COUNTS, METRICS, _SIZED, f"""selected AS (
  SELECT number, author, repo, state, created_at, title FROM sized WHERE additions IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY author ORDER BY additions + deletions DESC, repo, number) <= 10)""", _rollup(), select="""
SELECT author, total_prs, metric_prs, total_size, large_prs, round(average_pr_size, 6) AS average_pr_size FROM rollup"""),
    "recent_analysis_metrics": _with(
        PRS, DETAILS, DIFFS, COUNTS, METRICS, _selected(f"WHERE created_at >= {AS_OF} - INTERVAL 90 DAY"),
        _rollup("prs"), select="""
SELECT author, total_prs, metric_prs, total_size, security_prs, round(merge_rate, 6) AS merge_rate,
       round(average_pr_size, 6) AS average_pr_size, round(average_doc_ratio, 6) AS average_doc_ratio
FROM rollup"""),
    "pattern_findings": _with(*_ANALYSIS[:8], select="""
SELECT author, CAST(row_number() OVER (PARTITION BY author ORDER BY rule) - 1 AS INTEGER) AS position, finding AS text
FROM fired"""),
    "pattern_recommendations": _with(*_ANALYSIS[:8], select="""
SELECT author, CAST(row_number() OVER (PARTITION BY author ORDER BY rule) - 1 AS INTEGER) AS position, advice AS text
FROM fired"""),
    "pattern_risks": _with(*_ANALYSIS[:8], select="""
SELECT author, level, description FROM fired WHERE level IS NOT NULL"""),
    "trend_findings": _with(PRS, _summary(), TRENDS, select="SELECT author, finding AS text FROM trends"),
    "analysis_result": _with(*_ANALYSIS, select="""
SELECT author, total_prs AS total_prs_analyzed, 'test coverage, security' AS review_focus,
       'last 10' AS selection_criteria, '2001-08-02' AS analysis_date,
       total_additions, total_deletions, total_test_additions, total_doc_additions,
       round(test_to_code_ratio, 6) AS test_to_code_ratio, round(merge_rate, 6) AS merge_rate,
       round(average_pr_size, 6) AS average_pr_size, findings, recommendations, risks
FROM result"""),
    "analysis_bundles": _with(PRS, DETAILS, DIFFS, COUNTS, METRICS, f"""opened AS (
  SELECT author, repo, number,
         (row_number() OVER (PARTITION BY author ORDER BY {NEWEST}) - 1) // 3 AS part,
         row_number() OVER (PARTITION BY author ORDER BY {NEWEST}) AS place
  FROM prs WHERE state = 'OPEN')""", """parts AS (
  SELECT author, part, string_agg(CAST(number AS VARCHAR), ' ' ORDER BY place) AS numbers,
         string_agg(concat(repo, '#', number), ' ' ORDER BY concat(repo, '#', number))
           FILTER (number IN (SELECT number FROM metrics)) AS measured
  FROM opened GROUP BY author, part)""", select="""
SELECT author, coalesce(part, 0) AS part, 'test coverage, security' AS review_focus,
       coalesce(numbers, '') AS numbers, coalesce(measured, '') AS measured,
       CASE WHEN coalesce(part, 0) = 0 THEN n END AS total_prs_analyzed
FROM (SELECT author, count(*) FILTER (state = 'OPEN') AS n FROM prs GROUP BY author)
LEFT JOIN parts USING (author)"""),
    "api_pull_requests": _with(PRS, select=f"""
SELECT repo, number, state, title, {_BODY} AS body, strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at,
       CASE WHEN state <> 'OPEN' THEN {_DONE} END AS closed_at,
       CASE WHEN state = 'MERGED' THEN {_DONE} END AS merged_at,
       CASE WHEN author LIKE '%7' THEN 'unknown' ELSE author END AS author,
       concat('plain,', repo, ',') AS labels, concat('https://github.com/', repo, '/pull/', number) AS url
FROM prs"""),
    "api_pull_requests_rejected": _with(PRS, select="""
SELECT number, 'export.json' AS file, CASE WHEN number % 11 = 0 THEN 'not JSON' ELSE 'no repository' END AS reason
FROM prs WHERE number % 11 = 0 OR number % 23 = 0"""),
    "api_activity_summary": _with(PRS, """read AS (
  SELECT *, CASE WHEN author LIKE '%7' THEN 'unknown' ELSE author END AS named FROM prs WHERE number % 11 <> 0 AND number % 23 <> 0)""",
        select=f"""
SELECT named AS author, count(*) AS total_prs, count(*) FILTER (state = 'OPEN') AS open_prs, count(*) FILTER (state = 'CLOSED') AS closed_prs,
       count(*) FILTER (state = 'MERGED') AS merged_prs, {_rate("count(*) FILTER (state = 'MERGED')", "count(*)")} AS merge_rate
FROM read GROUP BY named"""),
    "api_pull_requests_only": _with(PRS, select="SELECT repo, number, state FROM prs WHERE state <> 'OPEN'"),
    "merge_status_enrich": _with(PRS, select=f"""
SELECT repo, number, author,
       CASE WHEN state = 'MERGED' AND number NOT IN (SELECT l_orderkey FROM lineitem) THEN 'CLOSED' ELSE state END AS state,
       CASE WHEN state = 'MERGED' AND number IN (SELECT l_orderkey FROM lineitem) THEN {_DONE} END AS merged_at
FROM prs"""),
    "api_pr_details": _with(PRS, DETAILS, select="""
SELECT repo, number, '' AS body, additions, deletions, changed_files, author, concat('branch-', number) AS head_ref_name,
       'main' AS base_ref_name, state = 'OPEN' AS is_draft
FROM prs JOIN details USING (number)"""),
    "pr_files": """
SELECT l_orderkey AS number,
       concat('src/f', l_partkey, CASE l_partkey % 3 WHEN 0 THEN '.ts' WHEN 1 THEN '.py' ELSE '.go' END) AS path,
       CAST(CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_quantity END AS BIGINT) AS additions,
       CAST(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS BIGINT) AS deletions,
       CASE l_linestatus WHEN 'O' THEN 'modified' ELSE 'added' END AS change_type
FROM lineitem""",
    "stored_report_rejected": _with(PRS, select="""
SELECT DISTINCT author, 'report.json' AS file, 'not JSON' AS reason FROM prs WHERE author LIKE '%3'"""),
    "language_filter": _select("""
WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = number AND l_partkey % 3 IN (0, 1))"""),
    "insight_prompt": _with(*_ANALYSIS, select=f"SELECT author, {INSIGHT} AS prompt FROM result"),
    "coaching_prompt": _with(*_ANALYSIS, REPOS, MONTHS, """repo_list AS (
  SELECT author, string_agg(concat('- ', repo, ': ', pr_count, ' PRs'), chr(10) ORDER BY repo_rank) AS repo_lines
  FROM repos WHERE repo_rank <= 5 GROUP BY author)""", """month_list AS (
  SELECT author, string_agg(concat('- ', month, ': ', pr_count, ' PRs'), chr(10) ORDER BY month_rank) AS month_lines
  FROM months WHERE month_rank <= 3 GROUP BY author)""", select=f"""
SELECT author, {COACHING} AS prompt
FROM result r JOIN summary s USING (author) JOIN repo_list USING (author) JOIN month_list USING (author)"""),
    "assessment_markdown": _with(*_ANALYSIS, select=f"""
SELECT author, {ASSESSMENT} AS assessment FROM result r JOIN summary s USING (author)"""),
    "coaching_records": _with(PRS, select=f"""
SELECT author AS "user", {_text(fixed.COACHING_REPORT, user="author", date="'2001-08-02'", advice="'Keep going.'")} AS coaching,
       '2001-08-02' AS date, 'analysis-2001-08-02T00-00-00' AS run
FROM (SELECT DISTINCT author FROM prs) WHERE author NOT LIKE '%0'"""),
    "coaching_report": _with(PRS, select=f"""
SELECT author, {_text(fixed.COACHING_REPORT, user="author", date="'2001-08-02'",
                      advice="concat('Well done: ', count(*), ' so far.')")} AS coaching
FROM prs GROUP BY author"""),
    "merge_insights": _with(*_ANALYSIS[:8], """listed AS (
  SELECT author, coalesce(string_agg(finding, '|' ORDER BY rule), '') AS findings,
         coalesce(string_agg(advice, '|' ORDER BY rule), '') AS recommendations
  FROM rollup LEFT JOIN fired USING (author) GROUP BY author)""", select="""
SELECT author, concat_ws('|', nullif(findings, ''), concat('Insight for ', author)) AS findings,
       concat_ws('|', nullif(recommendations, ''), 'Advice A', 'Advice B') AS recommendations
FROM listed WHERE right(author, 1) IN ('0', '1', '2', '3', '4', '5', '6') AND substr(author, -2, 1) NOT IN ('2', '3')"""),
    "rejected_insights": _with(PRS, RESPONSES, select="""
SELECT author, content, CASE WHEN right(author, 1) = '9' THEN 'no response' WHEN substr(author, -2, 1) = '2' THEN 'several responses'
                             WHEN right(author, 1) = '7' THEN 'no recommendations' ELSE 'not JSON' END AS problem
FROM (SELECT DISTINCT author FROM prs) LEFT JOIN responses USING (author)
WHERE right(author, 1) IN ('7', '8', '9') OR substr(author, -2, 1) IN ('2', '3')"""),
}

ORACLE["stored_activity_report"] = ORACLE["activity_report"]
ORACLE["stored_report_rest"] = f"SELECT * FROM ({ORACLE['activity_report']}) WHERE author NOT LIKE '%3'"
ORACLE["assessment_records"] = f"""
SELECT author AS \"user\", assessment, '2001-08-02' AS date, 'analysis-2001-08-02T00-00-00' AS run
FROM ({ORACLE['assessment_markdown']})"""
