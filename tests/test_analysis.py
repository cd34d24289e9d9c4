from __future__ import annotations

from pulltally.operators import analysis, insights, texts
from tests.data import metrics, pull_requests

SUMMARY = ("author STRING, part BIGINT, summary STRUCT<total_prs: BIGINT, open_prs: BIGINT, closed_prs: BIGINT, "
           "merged_prs: BIGINT, merge_rate: STRING, "
           "last_30_days: STRUCT<total_prs: BIGINT, merged_prs: BIGINT, merge_rate: STRING>, "
           "last_90_days: STRUCT<total_prs: BIGINT, merged_prs: BIGINT, merge_rate: STRING>>, "
           "repositories ARRAY<STRUCT<repo: STRING, count: BIGINT>>, "
           "monthly_activity ARRAY<STRUCT<month: STRING, count: BIGINT>>")


def report(spark, rate_30, rate_90, total_30=10, author="dev"):
    summary = (50, 5, 10, 35, "70.0", (total_30, 5, rate_30), (30, 25, rate_90))
    repos = [(f"org/r{i}", 40 - i) for i in range(7)]
    return spark.createDataFrame([(author, 0, summary, repos, [("2025-01", 15), ("2024-12", 20)])], SUMMARY)


def merged_one(spark):
    return pull_requests(spark, [(1, "MERGED", "2025-01-15T10:00:00", 100, 50)])


def test_rules(spark):
    rollup = analysis.analysis_metrics(merged_one(spark), metrics(spark, [(1, 10, 5, 2, 100, 50, 5)]))
    row = analysis.analyze_patterns(rollup).first()
    assert row.findings == [
        "Low test coverage: 10.0% average test-to-code ratio",
        "1 PRs contain potential security-sensitive changes"]
    assert row.recommendations == [
        "Implement mandatory test coverage requirements", "Review security-sensitive changes carefully"]
    assert [tuple(r) for r in row.risks] == [("high", "Insufficient test coverage increases regression risk")]


def test_result(spark):
    rollup = analysis.analysis_metrics(merged_one(spark), metrics(spark, [(1, 30, 10, 0, 100, 50, 5)]))
    row = analysis.analysis_result(rollup, None, "test coverage", "last 5", "2025-01-16").first()
    m = row.metrics
    assert (row.total_prs_analyzed, row.review_focus, row.analysis_date) == (1, "test coverage", "2025-01-16")
    assert (m.total_additions, m.total_deletions, m.total_test_additions) == (100, 50, 30)
    assert (m.test_to_code_ratio, m.merge_rate, m.average_pr_size) == (30.0, 100.0, 150.0)
    assert row.findings == []


def empty_rollup(spark):
    nothing = merged_one(spark).filter("false")
    authors = spark.createDataFrame([("dev",)], "author STRING")
    return analysis.analysis_metrics(nothing, metrics(spark, []), authors)


def test_nothing_selected(spark):
    row = analysis.analyze_patterns(empty_rollup(spark)).first()
    assert row.total_prs == 0 and row.average_test_ratio is None
    assert row.findings == ["Low merge rate detected: 0.0%", "Low documentation updates relative to code changes"]


def test_trends(spark):
    def found(*given):
        return analysis.analysis_result(empty_rollup(spark), report(spark, *given)).first().findings[2:]

    assert found("50.0", "83.3") == ["Merge rate declining: 50% (30d) vs 83.3% (90d)"]
    assert found("100.0", "89.9") == ["Merge rate improving: 100% (30d) vs 89.9% (90d)"]
    assert found("60.0", "70.0") == []
    assert found("0", "5.0", 4) == ["Low activity in the last 30 days"]
    assert found(None, None, None) == []


def test_sizes_and_copies(spark):
    prs = pull_requests(spark, [
        (1, "MERGED", "2025-01-15T10:00:00", None, None), (1, "MERGED", "2025-01-15T10:00:00", None, None),
        (2, "OPEN", "2025-01-15T10:00:00", 900, 102)])
    row = analysis.analysis_metrics(prs, metrics(spark, [(1, 0, 0, 0, 600, 500, 1)])).first()
    # Copies count as selected, their metrics once; without metrics the own size holds.
    assert (row.total_prs, row.merged_prs, row.metric_prs, row.total_additions) == (3, 2, 1, 600)
    assert (row.total_size, row.large_prs) == (1100 * 2 + 1002, 3)


def test_no_additions(spark):
    row = analysis.analysis_metrics(merged_one(spark), metrics(spark, [(1, 3, 3, 0, 0, 5, 1)])).first()
    assert (row.average_test_ratio, row.average_doc_ratio, row.test_to_code_ratio) == (0.0, 0.0, 0.0)
    assert row.documentation_percent == 300.0


def result(spark):
    rollup = analysis.analysis_metrics(merged_one(spark), metrics(spark, [(1, 10, 5, 2, 100, 50, 5)]))
    return analysis.analysis_result(rollup, None, "focus", "last 5", "2025-01-15")


def test_insight_prompt(spark):
    prompt = texts.insight_prompts(result(spark)).first().prompt
    assert prompt.startswith("\nAnalyze the following") and prompt.endswith('"recommendations".\n')
    assert "- Average PR size: 150 changes\n- Test-to-code ratio: 10.0%\n- Documentation ratio: 5.0%\n" in prompt
    assert "Current Findings:\nLow test coverage: 10.0%" in prompt


def test_coaching_prompt(spark):
    prompt = texts.coaching_prompts(result(spark), report(spark, "50.0", "83.3"), "2025-01-15").first().prompt
    assert "Developer: dev\nAnalysis Period: 1/15/2025\n" in prompt
    assert "- Total PRs: 50\n- Merge Rate: 70.0%\n" in prompt
    assert "- org/r4: 36 PRs\n\nMONTHLY" in prompt and "org/r5" not in prompt
    assert "- 2025-01: 15 PRs\n- 2024-12: 20 PRs\n" in prompt
    assert "- HIGH: Insufficient test coverage" in prompt


def test_coaching_prompt_without_report(spark):
    prompt = texts.coaching_prompts(result(spark), None, "2025-01-15").first().prompt
    assert "Analysis Period: Recent" in prompt and "- Merge Rate: 0%" in prompt
    assert "No repository data" in prompt and "No monthly data" in prompt


def test_assessment(spark):
    text = texts.assessments(result(spark), report(spark, "0", "0.0", 0), "2025-01-15").first().assessment
    assert text.startswith("# GitHub Code Quality Assessment\n\n**Date:** 2025-01-15  \n**User:** dev  \n")
    assert "| All Time | 50 | 35 | 70.0% |" in text
    assert "| Last 30 Days | N/A | 5 | 0% |" in text
    assert "- **HIGH**: Insufficient test coverage" in text
    assert "\n1. Implement mandatory test coverage requirements\n2. Review security" in text
    missing = texts.assessments(result(spark), None, "2025-01-15", footer="by us").first().assessment
    assert "| All Time | N/A | N/A | N/A% |" in missing and missing.endswith("---\n*by us*\n")


def test_coaching_report(spark):
    advice = spark.createDataFrame([("dev", "Dear dev,\n\nwell done.")], "author STRING, advice STRING")
    text = texts.coaching_reports(advice, "2025-01-15").first().coaching
    assert "**Developer:** dev  \n**Date:** 2025-01-15  \n" in text
    assert "---\n\nDear dev,\n\nwell done.\n\n---" in text and "🚀" in text


def test_insights(spark):
    good = '{"insights": ["i1", "i2"], "recommendations": ["r"]}'
    answers = [
        ("a", good), ("b", f"```json\n{good}\n```"), ("c", "no JSON"), ("d", '{"insights": ["x"]}'),
        ("e", "{'insights': [], 'recommendations': []}"), ("f", good + " and more"),
        ("k", good), ("k", good), ("k", None), ("l", good), ("l", "?"), ("m", good + "}"), ("n", good + "]"), ("o", good + "] }"),
        ("p", f"{good}, {good}"), ("q", f"[{good}]"), ("r", '{"insights": ["x", null], "recommendations": [null]}'),
        ("h", '{"insights": [], "recommendations": []}'), ("i", '{"recommendations": []}'), ("j", "")]
    base = spark.createDataFrame([(name, ["own"], ["own"]) for name in sorted({name for name, _ in answers} | {"g"})],
                                 "author STRING, findings ARRAY<STRING>, recommendations ARRAY<STRING>")
    merged, rejected = insights.merge_insights(base, spark.createDataFrame(answers, "author STRING, content STRING"))
    rows = {r.author: r for r in merged.collect()}
    assert sorted(rows) == ["a", "b", "h", "k", "r"] and merged.count() == 5
    assert rows["r"].findings == ["own", "x"] and rows["r"].recommendations == ["own"]
    assert rows["b"].findings == ["own", "i1", "i2"] and rows["b"].recommendations == ["own", "r"]
    assert rows["h"].findings == ["own"]
    problems = {r.author: r.problem for r in rejected.collect()}
    assert problems == {"c": "not JSON", "d": "no recommendations", "e": "not JSON", "f": "not JSON",
                        "g": "no response", "i": "no insights", "j": "not JSON", "l": "several responses",
                        **dict.fromkeys("mnopq", "not JSON")}
