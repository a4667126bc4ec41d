import json
from datetime import datetime, timezone

import pytest

from repoaudit.plans import audit, lines
from repoaudit.sources.registry import parse_snapshot

AS_OF = datetime(2024, 2, 20, 1, 2, 3, tzinfo=timezone.utc)

FILES = [
    ("demo", "requirements.txt", "flask==1\nflaks\nmade-up\nnew\n"),
    ("demo", "app.py", 'import requests\n\ntoken = "a\\bcd`|"\nrequests.post_json(eval(x))\nDEBUG = True\n'),
    ("demo", "src/b.ts", "x = 'http://x.example/'"),
    ("clean", "a.py", "print(1)\n"),
]

EXPECTED = """# 🔴 RepoAudit Security Report

**Repository:** `demo-app`  
**Scan Date:** 2024-02-20 01:02:03 UTC  
**Risk Score:** **80/100** — 🔴 Critical  

## Executive Summary

RepoAudit scanned **`demo-app`** and identified **9** issue(s) across three audit dimensions:

| Category | Issues |
|---|---|
| 📦 Dependency Audit | 4 |
| 🔒 Security Scan | 4 |
| 🤖 API Hallucination Check | 1 |
| **Total** | **9** |

## 📦 Dependency Audit Results

| Package | Status | Risk | Details |
|---|---|---|---|
| `flask` | ✅ Found | — |  |
| `flaks` | ✅ Found | ⚠️ Typosquat (medium) | Looks like: flask |
| `made-up` | ❌ Not found | — | Package does not exist in the registry (hallucinated) |
| `new` | ✅ Found | — | Suspiciously new (3 days old) |

## 🔒 Security Scan Results

**Severity Breakdown:** 🔴 Critical: 1 · 🟠 High: 1 · 🟡 Medium: 2 · 🟢 Low: 0

| # | File | Line | Severity | Category | Description |
|---|---|---|---|---|---|
| 1 | `app.py` | 3 | 🔴 Critical | hardcoded_password | Hardcoded password or secret |
| 2 | `app.py` | 4 | 🟠 High | dangerous_exec | Dangerous code execution |
| 3 | `app.py` | 5 | 🟡 Medium | debug_in_production | Debug mode enabled — should not be used in production |
| 4 | `src/b.ts` | 1 | 🟡 Medium | insecure_http | Insecure HTTP usage or disabled TLS verification |

### Critical & High Severity Details

**app.py:3** — Hardcoded password or secret
```
token = "a\\bcd`|"
```

**app.py:4** — Dangerous code execution
```
requests.post_json(eval(x))
```

## 🤖 API Hallucination Check

Files scanned: **1**

| File | Line | Module | Called Function | Suggestion |
|---|---|---|---|---|
| `app.py` | 4 | `requests` | `post_json` | 'requests.post_json' does not exist. Did you mean 'requests.post'? |

## 📋 Recommendations

1. **Remove non-existent packages** (`made-up`). These were likely hallucinated by an AI code generator and will cause installation failures or, worse, install a malicious package.
2. **Verify potentially typosquatted packages** (`flaks`). Confirm these are the intended packages and not malicious look-alikes.
3. **Immediately rotate any exposed secrets.** Hardcoded API keys and passwords must be moved to environment variables or a secrets manager (e.g., AWS Secrets Manager, HashiCorp Vault).
4. **Fix high-severity issues** including SQL injection risks, dangerous `eval`/`exec` usage, and insecure deserialization. Use parameterized queries, avoid `eval`, and use safe loaders.
5. **Address medium-severity issues** such as disabled TLS verification, debug mode in production, and weak crypto algorithms.
6. **Fix hallucinated API calls.** Replace non-existent function calls with the correct API. Consult official package documentation.

---
*Report generated by RepoAudit v0.1.0 at 2024-02-20 01:02:03 UTC*
"""


def _doc(created):
    return json.dumps(
        {"info": {"version": "1"}, "releases": {"1": [{"upload_time_iso_8601": created}]}}
    )


@pytest.fixture(scope="module")
def result(spark):
    files = spark.createDataFrame(FILES, "repo string, path string, content string")
    docs = [("pypi", n, _doc("2020-01-01T00:00:00Z"), "found", None) for n in ("flask", "flaks")]
    docs.append(("pypi", "new", _doc("2024-02-17T00:00:00Z"), "found", None))
    meta = parse_snapshot(
        spark.createDataFrame(
            docs, "registry string, name string, doc string, lookup_status string, lookup_error string"
        )
    )
    repos = spark.createDataFrame(
        [("demo", "/x/demo-app/", True), ("clean", "/x/clean", True), ("gone", "/x/gone", False)],
        "repo string, root string, found boolean",
    )
    found = audit.audit(files, meta, repos, AS_OF)
    return found, audit.report(found, AS_OF)


def _text(lines_, repo, max_lines=100_000):
    rows = lines.documents(lines_, max_lines).where(f"repo = '{repo}'").orderBy("part").collect()
    assert [r.part for r in rows] == list(range(rows[0].parts))
    return "".join(r.text for r in rows)


def test_markdown(result):
    assert _text(result[1].markdown_lines, "demo") == EXPECTED


def test_markdown_in_small_parts_is_the_same(result):
    assert _text(result[1].markdown_lines, "demo", max_lines=7) == EXPECTED


def test_markdown_of_a_clean_repository(result):
    text = _text(result[1].markdown_lines, "clean")
    assert "# 🟢 RepoAudit Security Report" in text and "**0/100** — 🟢 Low" in text
    for line in (
        "*No dependency issues detected.*", "*No security vulnerabilities detected.* ✅",
        "*No hallucinated API calls detected.* ✅", "Files scanned: **1**",
        "1. No critical issues found — keep following security best practices! 🎉",
    ):
        assert f"\n{line}\n" in text
    assert "| # |" not in text and "### Critical" not in text


def test_json(result):
    doc = json.loads(_text(result[1].json_lines, "demo"))
    assert doc["report_version"] == "1.0" and doc["repository"] == "demo-app"
    assert doc["timestamp"] == "2024-02-20T01:02:03+00:00"
    assert (doc["risk_score"], doc["risk_level"]) == (80, "Critical")
    assert doc["summary"] == {
        "total_issues": 9, "dependency_issues": 4, "security_issues": 4, "api_hallucinations": 1,
    }
    dep = doc["dependency_audit"]
    assert dep["dependency_files_found"] == ["requirements.txt"] and dep["total_packages"] == 4
    assert dep["hallucinated_packages"] == ["made-up"]
    assert dep["typosquat_warnings"] == ["flaks"] and dep["new_package_warnings"] == ["new"]
    assert dep["findings"][1] == {
        "package": "flaks", "source_file": "requirements.txt", "registry": "pypi", "exists": True,
        "version": "1", "typosquat_risk": "medium",
        "typosquat_similar_to": [{"name": "flask", "distance": 2}], "age_days": 1511,
    }
    assert dep["findings"][2]["version"] is None
    sec = doc["security_scan"]
    assert sec["severity_breakdown"] == {"critical": 1, "high": 1, "medium": 2, "low": 0}
    assert sec["findings"][0]["code_snippet"] == 'token = "a\\bcd`|"'
    assert [f["line_number"] for f in sec["findings"]] == [3, 4, 5, 1]
    assert doc["api_check"]["total_files_scanned"] == 1
    assert doc["api_check"]["findings"][0]["exists_in_api"] is False
    assert len(doc["recommendations"]) == 6
    clean = json.loads(_text(result[1].json_lines, "clean", max_lines=3))
    assert clean["security_scan"]["findings"] == [] and len(clean["recommendations"]) == 1


def test_totals_and_missing_roots(result):
    found, _ = result
    rows = {r.repo: r for r in audit.security_result(found.security, found.repos).collect()}
    assert (rows["demo"].total_issues, rows["demo"].medium, rows["demo"].error) == (4, 2, None)
    assert rows["gone"].error == (
        "Repository path does not exist or is not a directory: /x/gone"
    )
    rows = {r.repo: r for r in audit.api_result(found.parsed, found.api, found.repos).collect()}
    assert (rows["clean"].total_files_scanned, rows["demo"].total_hallucinated_calls) == (1, 1)
    assert rows["gone"].total_files_scanned == 0 and rows["gone"].error


def test_written_reports(result, tmp_path):
    saved = audit.write_report(result[1], str(tmp_path / "out"))
    folder = tmp_path / "out" / "markdown" / "repo=demo"
    text = "".join(p.read_text() for p in sorted(folder.glob("part-*")))
    assert text == EXPECTED
    folder = tmp_path / "out" / "json" / "repo=demo"
    json.loads("".join(p.read_text() for p in sorted(folder.glob("part-*"))))
    assert set(saved) == {"markdown", "json"}
