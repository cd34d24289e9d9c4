"""Texts, patterns and thresholds that reports must carry as they are.

Everything in this file is a constant of the report format. Placeholders in
braces are filled from columns by ``functions.text.fill``.
"""

# --- Fixed values: sources -------------------------------------------------

API_REPO_PREFIX = "https://api.github.com/repos/"
UNKNOWN_AUTHOR = "unknown"

# --- Fixed values: what an added diff line is searched for, in small letters

ADDED_LINE_MARK = "+"
TEST_WORDS = ("test", ".spec.")
DOC_WORDS = ("readme", ".md", "/**", "///")
DOC_COMMENT_WORDS = ("todo", "fixme")
DOC_COMMENT_PATTERN = r"#[^\n\r\x{2028}\x{2029}]*(?:todo|fixme)"
SECURITY_WORDS = ("password", "secret", "token", "api_key", "private_key", "auth")

# --- Fixed values: windows, sizes and thresholds ---------------------------

REPORT_WINDOW_DAYS = (30, 90)
RECENT_PRS = 30
PROMPT_REPOSITORIES = 5
PROMPT_MONTHS = 3
DEFAULT_SELECTION = 5
UNREVIEWED_SELECTION = 10
SELECTION_WINDOW_DAYS = {"last-week": 7, "last-30-days": 30, "last-90-days": 90}
LOW_MERGE_RATE = 50.0
LOW_TEST_RATIO = 0.2
LOW_DOC_RATIO = 0.05
LARGE_PR_CHANGES = 1000
LARGE_PR_SHARE = 0.3
TREND_POINTS = 10.0
LOW_ACTIVITY_PRS = 5
DEFAULT_FOCUS = "test coverage, code quality, architecture"
QUICK_FOCUS = "test coverage, code quality, architecture, security"
DEFAULT_CRITERIA = "last 10"
DEFAULT_OUTPUT = "./insights"

# --- Fixed values: rule texts ----------------------------------------------

LOW_MERGE_FINDING = "Low merge rate detected: {rate}%"
LOW_MERGE_RISK = ("high", "Low merge rate indicates potential workflow issues")
LOW_MERGE_ADVICE = "Investigate PR review and merge process"

LOW_TEST_FINDING = "Low test coverage: {ratio}% average test-to-code ratio"
LOW_TEST_RISK = ("high", "Insufficient test coverage increases regression risk")
LOW_TEST_ADVICE = "Implement mandatory test coverage requirements"

LARGE_PR_FINDING = "{count} PRs exceed 1000 changes"
LARGE_PR_RISK = ("medium", "Large PRs are difficult to review effectively")
LARGE_PR_ADVICE = "Break down large PRs into smaller, focused changes"

LOW_DOC_FINDING = "Low documentation updates relative to code changes"
LOW_DOC_ADVICE = "Improve documentation practices and requirements"

SECURITY_FINDING = "{count} PRs contain potential security-sensitive changes"
SECURITY_ADVICE = "Review security-sensitive changes carefully"

DECLINING_FINDING = "Merge rate declining: {rate_30}% (30d) vs {rate_90}% (90d)"
IMPROVING_FINDING = "Merge rate improving: {rate_30}% (30d) vs {rate_90}% (90d)"
LOW_ACTIVITY_FINDING = "Low activity in the last 30 days"

# --- Fixed values: prompt and report texts ---------------------------------

NOT_AVAILABLE = "N/A"
NO_USER = "authenticated user"
NO_REPOSITORIES = "No repository data"
NO_MONTHS = "No monthly data"
NO_PERIOD = "Recent"
COUNT_LINE = "- {name}: {count} PRs"
RISK_LINE = "- {level}: {description}"
RISK_BULLET = "- **{level}**: {description}"
FINDING_BULLET = "- {text}"
NUMBERED_LINE = "{number}. {text}"

INSIGHT_PROMPT = """
Analyze the following GitHub repository metrics and provide specific, actionable insights:

Review Focus: {review_focus}

Metrics:
- Total PRs analyzed: {total_prs}
- Merge rate: {merge_rate}%
- Average PR size: {average_size} changes
- Test-to-code ratio: {test_ratio}%
- Documentation ratio: {doc_ratio}%

Current Findings:
{findings}

Based on this data and the review focus, provide:
1. 3-5 additional specific insights about code quality and development practices
2. 3-5 concrete recommendations for improvement
3. Identify any patterns or trends that need attention

Format your response as JSON with arrays for "insights" and "recommendations".
"""

COACHING_PROMPT = """You are a senior software engineer with 15+ years of experience, known for mentoring and developing talent. 
You're reviewing a peer's GitHub activity and code quality metrics to provide constructive, actionable coaching advice.

Developer: {user}
Analysis Period: {period}

ACTIVITY SUMMARY:
- Total PRs: {total_prs}
- Merge Rate: {merge_rate}%
- Open PRs: {open_prs}
- Closed PRs: {closed_prs}
- Merged PRs: {merged_prs}

TOP REPOSITORIES:
{repositories}

MONTHLY ACTIVITY TREND:
{months}

CODE QUALITY METRICS:
- Test Coverage Ratio: {test_ratio}%
- Documentation Updates: {doc_lines} lines
- Average PR Size: {average_size} changes
- Total Code Changes: +{additions} / -{deletions}

KEY FINDINGS:
{findings}

IDENTIFIED RISKS:
{risks}

Based on this data, write a personal, encouraging coaching letter to {user}. Structure it as follows:

1. **Opening**: Warm greeting acknowledging their efforts and contributions
2. **Strengths Recognition**: Highlight 2-3 specific strengths based on the data
3. **Growth Opportunities**: Identify 3-4 specific areas for improvement with concrete suggestions
4. **Skill Development Plan**: Provide a prioritized 30/60/90 day plan for skill improvement
5. **Resources & Next Steps**: Suggest specific resources, practices, or habits to adopt
6. **Closing**: Encouraging message about their potential and growth trajectory

Write in a supportive, peer-to-peer tone. Be specific with examples from their data, but focus on growth and improvement rather than criticism. 
Include practical tips they can implement immediately. Make it personal and actionable."""

ASSESSMENT_REPORT = """# GitHub Code Quality Assessment

**Date:** {date}  
**User:** {user}  
**Review Focus:** {review_focus}  
**PRs Analyzed:** {total_prs}  
**Selection Criteria:** {criteria}

## Executive Summary

This analysis examined {total_prs} pull requests to assess code quality, development practices, and areas for improvement.

### Key Metrics

| Metric | Value |
|--------|--------|
| Merge Rate | {merge_rate}% |
| Average PR Size | {average_size} changes |
| Test-to-Code Ratio | {test_ratio}% |
| Documentation Updates | {doc_lines} lines |
| Total Code Changes | +{additions} / -{deletions} |

### Activity Trends

| Period | Total PRs | Merged PRs | Merge Rate |
|--------|-----------|------------|------------|
| All Time | {total_all} | {merged_all} | {rate_all}% |
| Last 90 Days | {total_90} | {merged_90} | {rate_90}% |
| Last 30 Days | {total_30} | {merged_30} | {rate_30}% |

## Findings

{findings}

## Risk Assessment

{risks}

## Recommendations

{recommendations}

## Next Steps

1. Address high-risk issues immediately
2. Implement recommended process improvements
3. Schedule follow-up analysis in 30 days
4. Track improvement metrics

---
*{footer}*
"""

COACHING_REPORT = """# Personal Development Coaching Report

**Developer:** {user}  
**Date:** {date}  
**Prepared by:** Senior Engineering Mentor

---

{advice}

---

## Remember

Growth is a journey, not a destination. Every PR, every code review, and every refactoring is an opportunity to improve. The fact that you're seeking feedback shows you're already on the right path.

Keep coding, keep learning, and keep pushing yourself to new heights! 🚀

*This coaching report was generated based on your GitHub activity analysis. Use it as a guide for continuous improvement.*"""

# --- Own values (not part of the format) -----------------------------------

REPORT_FOOTER = "Generated by pulltally"

LANGUAGE_EXTENSIONS = {
    "c": ("c", "h"),
    "c#": ("cs",),
    "c++": ("cc", "cpp", "cxx", "hh", "hpp", "hxx"),
    "css": ("css", "scss"),
    "go": ("go",),
    "html": ("htm", "html"),
    "java": ("java",),
    "javascript": ("cjs", "js", "jsx", "mjs"),
    "kotlin": ("kt", "kts"),
    "php": ("php",),
    "python": ("py", "pyi"),
    "ruby": ("rb",),
    "rust": ("rs",),
    "scala": ("scala",),
    "shell": ("bash", "sh"),
    "sql": ("sql",),
    "swift": ("swift",),
    "typescript": ("cts", "mts", "ts", "tsx"),
}
