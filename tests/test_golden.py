"""Exact cases that are easy to get wrong."""

from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve import rules as R
from codesieve.operators import changes, detect, duplicates, enrich, licenses, policy, reports
from codesieve.plans.scan import ScanOptions, scan, verdicts


def types(df):
    return sorted(r.type for r in df.select("type").collect())


def test_marker_with_finding(files):
    f = files("# generated by Copilot\nx = eval(y)")
    found = policy.apply_policy(detect.security(f))
    rows = {r.type: r for r in found.collect()}
    assert set(rows) == {"insecure_deserialization", "copilot_generated_code", "copilot_insecure_suggestion"}
    assert rows["insecure_deserialization"].policy_level == "blocking"
    assert rows["copilot_generated_code"].policy_level == "blocking"
    told = rows["copilot_insecure_suggestion"]
    assert (told.policy_level, told.copilot_strict, told.copilot_generated) == ("warning", None, True)
    assert (told.related_issue, told.start, told.end, told.match) == ("insecure_deserialization", 27, 32, None)
    assert policy.file_verdict(f, found).collect()[0].policy == "blocking"


def test_strict_can_be_off(files):
    found = policy.apply_policy(detect.security(files("# copilot suggestion")), strict=False).collect()
    assert [r.policy_level for r in found] == ["warning"]


def test_generated_flag_without_findings(files):
    f = files("plain").withColumn("ai_generated", F.lit(True))
    found = scan(f)
    assert found.count() == 0
    assert verdicts(f, found)[0].collect()[0].policy == "advisory"


def test_generated_flag_marks_security_only(files):
    f = files("eval(x)\nprint(x)").withColumn("ai_generated", F.lit(True))
    rows = {r.type: r for r in scan(f).collect()}
    assert rows["insecure_deserialization"].policy_level == "blocking"
    assert rows["logging_practice"].copilot_strict is None


def test_level_depends_on_type_only(files):
    found = policy.apply_policy(detect.sector(files("# subscriber"), [r for r in R.sector_rules() if r["pack"] == "telecom"]))
    assert [(r.type, r.severity, r.policy_level) for r in found.collect()] == [("pii_handling", "warning", "advisory")]


def test_request_policy_replaces_default(files):
    found = policy.apply_policy(detect.security(files("eval(x)")), policy.policy_frame(files("x").sparkSession, {"other": "blocking"}))
    assert found.collect()[0].policy_level == "advisory"


def test_sql_fires_two_patterns(files):
    found = detect.security(files('execute("SELECT a FROM t WHERE a = " + x)'))
    assert types(found) == ["sql_injection_risk"] * 2


def test_spdx_file_and_repository(files):
    f = files(("b", "LICENSE", "SPDX-License-Identifier: GPL-3.0"))
    found = [(r.type, r.license) for r in detect.detect(f, R.license_rules() + R.restricted_rules()).collect()]
    assert sorted(found) == [("license_detected", "GPL-3.0"), ("restricted_license", "GPL")]
    assert [(r.type, r.license) for r in licenses.repo_licenses(f).collect()] == [("repo_license_detected", "GPL-3.0")]
    exact = files(("b", "LICENSE", "SPDX-License-Identifier: gpl"))
    assert sorted(types(licenses.repo_licenses(exact))) == ["repo_license_detected", "restricted_license"]


def test_line_three_times(files):
    rows = duplicates.duplicate_lines(files("}\n a\n}\n\n  }")).collect()
    assert sorted((r.line, r.original_line, r.snippet) for r in rows) == [(3, 1, "}"), (5, 1, "}")]


def test_bare_and_broad_except(files):
    rows = detect.coding(files("except Exception:\nexcept:\n")).collect()
    assert sorted((r.start, r.end) for r in rows) == [(0, 17), (18, 25)]


def test_print_inside_words(files):
    assert types(detect.coding(files("fingerprint(x); pprint(y)"))) == ["logging_practice"] * 2


def test_language_groups(files):
    text = "def Bad():\n    print(1)\nexcept:\n"
    f = files(("b", "a.go", text), ("b", "a.java", text), ("b", "a.rs", text), ("b", "a.html", text), ("b", "a.md", text))
    assert {r.path for r in detect.coding(f).collect()} == {"a.rs", "a.html", "a.md"}


def _diff(spark, patch, **kw):
    rows = spark.createDataFrame([("b", "p", patch)], "batch_id string, path string, patch string")
    return sorted(r.line for r in changes.diff_lines(rows, **kw).collect())


def test_diff_readings(spark):
    patch = "@@ -1,2 +5,3 @@ f\n a\n+++x\n-c\n d\n\\ No newline at end of file\n"
    assert _diff(spark, patch) == [5, 6, 7]
    assert _diff(spark, patch, as_posted=True) == [5, 6, 7, 8]
    assert _diff(spark, "") == []
    assert _diff(spark, "", as_posted=True) == [0]
    assert _diff(spark, None) == []
    assert _diff(spark, "--- a\n+++ b\n@@ -1 +1 @@\n+x\n@@ -9 +9,2 @@\n y\n+z") == [1, 9, 10]


def test_annotations_need_a_place(files):
    f = files('x\napi_key = "1234567890abcdef"\nMIT License\ntransaction_id')
    found = scan(f)
    notes = changes.annotations(found, f).collect()
    assert [(n.title, n.start_line, n.annotation_level) for n in notes] == [("hardcoded_secret", 2, "failure")]
    assert notes[0].message.split("\n")[1:4] == [
        "Suggestion: Move secrets to environment variables or a secret manager.", "OWASP: A02:2021", "CWE: CWE-798"]


def test_comments_only_on_changed_lines_and_once(spark, files):
    f = files("eval(a)\neval(b)\neval(c)")
    found = scan(f)
    changed = spark.createDataFrame([("b", "f0.py", 1), ("b", "f0.py", 2)], "batch_id string, path string, line int")
    first = changes.review_comments(found, f, changed)
    assert sorted(r.line for r in first.collect()) == [1, 2]
    posted = changes.existing_comments(first.where("line = 1").select("batch_id", "path", "line", "body"))
    assert [r.line for r in changes.review_comments(found, f, changed, posted).collect()] == [2]


def test_overridden_blocking_is_success(spark):
    rows = spark.createDataFrame([("blocking", ["scan-override"]), ("blocking", []), ("warning", None), ("advisory", [])],
                                 "policy string, labels array<string>")
    out = rows.select(changes.conclusion(F.col("policy"), changes.has_override(F.col("labels"))).alias("c")).collect()
    assert [r.c for r in out] == ["success", "failure", "neutral", "success"]


def test_summary_readings(spark):
    schema = ("event string, policy string, output struct<issues:array<int>,coding_issues:array<int>,license_ip_issues:array<int>,"
              "sector_issues:array<int>,ai_suggestions:array<int>,repo_license_issues:array<int>,"
              "findings:map<string,struct<issues:array<int>,coding_issues:array<int>,license_ip_issues:array<int>,"
              "sector_issues:array<int>,ai_suggestions:array<int>,repo_license_issues:array<int>>>,"
              "counts:struct<issues:int,coding:int,license_ip:int,sector:int,ai:int,repo_license:int>>")
    rows = [
        (None, "blocking", ([1, 2], [], [], [], [], [], None, None)),
        (None, "warning", (None, None, None, None, None, [1], {"a": ([1], [2], [], [], [], None), "b": ([1, 2], [], [], [], [], None)}, None)),
        (None, "odd", (None, None, None, None, None, None, None, (4, 0, 0, 0, 0, 0))),
        ("resolution", None, None),
    ]
    log = spark.createDataFrame(rows, schema)
    plain = reports.summary(log, faithful=True).collect()[0]
    assert (plain.total_requests, plain.advisory, plain.warning, plain.blocking) == (4, 1, 1, 1)
    assert (plain.issues, plain.coding, plain.repo_license) == (2, 0, 1)
    full = reports.summary(log).collect()[0]
    assert (full.total_requests, full.advisory, full.issues, full.coding) == (3, 0, 9, 1)


def test_override_layers(spark):
    rows = spark.createDataFrame([("blocking", True, None), ("blocking", None, False), ("blocking", None, None), ("warning", True, True)],
                                 "policy string, c boolean, s boolean")
    out = rows.select(policy.override_allowed(F.col("policy"), F.col("c"), F.col("s")).alias("o")).collect()
    assert [r.o for r in out] == [True, False, True, False]


def test_custom_policy_per_batch(spark, files):
    f = files(("b1", "a.py", "eval(x)"), ("b2", "a.py", "eval(x)"))
    batches = spark.createDataFrame([("b1", {"insecure_deserialization": "blocking"}), ("b2", {})], "batch_id string, policy map<string,string>")
    found = scan(f, batches=batches, options=ScanOptions(cross_file=False))
    levels = {r.batch_id: r.policy_level for r in found.where("family = 'issues'").collect()}
    assert levels == {"b1": "blocking", "b2": "advisory"}


def test_nested_and_redacted(files):
    f = files('password = "abcdefgh1"\nprint(1)', "nothing")
    nested = enrich.nest_findings(f, scan(f))
    rows = {r.path: r for r in nested.collect()}
    assert [len(rows["f0.py"][n]) for n in ("issues", "coding_issues", "license_ip_issues", "sector_issues", "ai_suggestions")] == [1, 1, 0, 0, 0]
    assert rows["f0.py"].issues[0].match == 'password = "abcdefgh1"'
    assert rows["f1.py"].issues == []
    hidden = enrich.redact_nested(nested).schema["issues"].dataType.elementType.names
    assert not set(hidden) & set(fv.REDACTED_FIELDS)


def test_remaining_counts_errors(spark, files):
    clean = scan(files("nothing"))
    row = reports.remaining(clean).collect()[0]
    assert (row.total, row.exit_code) == (0, 0)
    errors = spark.createDataFrame([("a", "failed"), ("b", "failed")], "path string, error string")
    row = reports.remaining(clean, errors).collect()[0]
    assert (row.errors, row.total, row.exit_code) == (2, 2, 2)


def test_license_names_in_order_of_their_place(files):
    from codesieve.operators import licenses

    code = "SPDX-License-Identifier: Zlib\nSPDX-License-Identifier: Apache-2.0\nMIT License SPDX-License-Identifier: Zlib"
    seen = {r.license: (r.seen.file_ord, r.seen.rule_ord, r.seen.start) for r in licenses.license_names(files(("b", "LICENSE", code), ("b", "COPYING", "SPDX-License-Identifier: BSD-3"))).collect()}
    names = sorted(seen, key=seen.get)
    assert names.index("Zlib") < names.index("Apache-2.0") < names.index("BSD-3") and len(names) == 4


def test_reviewer_sees_whole_texts_unless_told(files):
    from codesieve.operators import review

    long = "x" * 30_000
    seen = review.review(files(("b", "a.py", long)), lambda p: '[{"type": "n", "message": "%d"}]' % p.count("x")).collect()
    cut = review.review(files(("b", "a.py", long)), lambda p: '[{"type": "n", "message": "%d"}]' % p.count("x"), max_chars=100).collect()
    assert int(seen[0].message) >= 30_000 and 100 <= int(cut[0].message) < 200
