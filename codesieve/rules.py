"""The rule table: built-in detectors, sector packs and user rules as rows of one schema."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from codesieve import fixed_values as fv

RULE_SCHEMA = (
    "pack string, kind string, family string, detector string, detector_ord int, rule_ord int, pattern_ord int,"
    " lang_group string, language string, toggle string, pattern string, ignore_case boolean, multiline boolean,"
    " match_group int, exists_only boolean, type string, category string, label string, license string,"
    " rule_id string, message string, suggestion string, note string, cwe string, owasp string, severity string"
)
RULE_FIELDS = [part.split()[0] for part in RULE_SCHEMA.split(", ")]

# Up to this many rules are expressions of the plan; longer tables are searched by automaton.
PLAN_RULES = 300


def _rule(**values) -> dict:
    row = dict.fromkeys(RULE_FIELDS)
    row.update(pack="builtin", kind="builtin", rule_ord=1, pattern_ord=1, ignore_case=False, multiline=False,
               match_group=0, exists_only=False)
    row.update(values)
    return row


# --- Fixed values: texts of the built-in detectors ---------------------------------
# (detector, order, type, patterns, ignore case, message, suggestion, cwe, owasp, severity)
_SECURITY = [
    ("hardcoded_secret", 1, [p for _, p in fv.SECRET_PATTERNS], False,
     "Potential hardcoded secret detected.",
     "Move secrets to environment variables or a secret manager.", "CWE-798", "A02:2021", "blocking"),
    ("sql_injection_risk", 2, fv.SQL_CONCAT_PATTERNS, True,
     "Possible SQL injection via string concatenation.",
     "Use parameterized queries or ORM bindings.", "CWE-89", "A03:2021", "blocking"),
    ("insecure_deserialization", 3, fv.DESERIALIZATION_PATTERNS, False,
     "Potentially unsafe deserialization call.",
     "Use safe loaders or avoid deserializing untrusted data.", "CWE-502", "A08:2021", "warning"),
    ("unsafe_execution", 4, fv.UNSAFE_EXEC_PATTERNS, False,
     "Potential unsafe command execution.",
     "Avoid shell execution or strictly validate inputs.", "CWE-78", "A01:2021", "warning"),
    ("path_traversal_risk", 5, fv.PATH_TRAVERSAL_PATTERNS, True,
     "Possible path traversal via user input.",
     "Normalize paths and restrict to a safe base directory.", "CWE-22", "A01:2021", "warning"),
    ("unsafe_file_operation", 6, fv.UNSAFE_FILE_PATTERNS, True,
     "Potential unsafe file operation using untrusted input.",
     "Validate and normalize file paths and restrict to an allowlist base directory.",
     "CWE-73", "A01:2021", "warning"),
    ("insecure_crypto", 7, fv.WEAK_CRYPTO_PATTERNS, True,
     "Weak or deprecated cryptographic primitive detected.",
     "Use modern algorithms like SHA-256 or AES-GCM.", "CWE-327", "A02:2021", "warning"),
]

# (detector, order, toggle, language group, language, patterns, group, message, suggestion)
_CODING = [
    ("naming_convention", 1, "naming", "generic", None, [fv.NAMING_GENERIC], 1,
     "Function '{}' should be snake_case.", "Rename to snake_case."),
    ("naming_convention", 1, "naming", "js", None, fv.NAMING_JS, 1,
     "Identifier '{}' should be camelCase in JavaScript/TypeScript.", "Rename to camelCase."),
    ("naming_convention", 1, "naming", "java", None, [fv.NAMING_JAVA], 1,
     "Method '{}' should be camelCase in Java.", "Rename to camelCase."),
    ("logging_practice", 2, "logging", "generic", None, [fv.LOGGING_GENERIC], 0,
     "Use logging instead of print().", "Replace print() with logging calls."),
    ("logging_practice", 2, "logging", "js", None, [fv.LOGGING_JS], 0,
     "Use structured logging instead of console.* in production code.",
     "Replace console.* with your logging utility."),
    ("logging_practice", 2, "logging", "java", None, [fv.LOGGING_JAVA], 0,
     "Use a logger instead of System.out.println().",
     "Replace with a logging framework (e.g., SLF4J)."),
    ("logging_practice", 2, "logging", "go", None, [fv.LOGGING_GO], 0,
     "Use structured logging instead of fmt.Print* in production code.",
     "Replace fmt.Print* with a logger."),
    ("error_handling", 3, "error_handling", "generic", None, [fv.BARE_EXCEPT], 0,
     "Avoid bare except; catch specific exceptions.", "Specify the exception type."),
    ("error_handling", 3, "error_handling", "generic", None, [fv.BROAD_EXCEPT], 0,
     "Avoid catching broad Exception; catch specific exceptions.",
     "Catch only the exceptions you expect."),
    ("error_handling", 3, "error_handling", "js", None, [fv.EMPTY_CATCH_JS], 0,
     "Avoid empty catch blocks; handle or rethrow the error.",
     "Log and rethrow or handle the error explicitly."),
    ("error_handling", 3, "error_handling", "java", None, [fv.BROAD_CATCH_JAVA], 0,
     "Avoid catching broad Exception; catch specific exceptions.",
     "Catch only the exceptions you expect."),
    ("error_handling", 3, "error_handling", "java", None, [fv.EMPTY_CATCH_JAVA], 0,
     "Avoid empty catch blocks; handle or rethrow the error.",
     "Log and rethrow or handle the error explicitly."),
    ("error_handling", 3, "error_handling", "go", None, [fv.IGNORED_ERROR_GO], 0,
     "Possible ignored error return value detected.",
     "Capture and handle the error explicitly."),
    ("error_handling", 3, "error_handling", "go", None, [fv.PANIC_GO], 0,
     "Avoid panic in application code; return errors instead.",
     "Return an error and handle it upstream."),
    ("coding_standard", 4, "typing", "js", "typescript", [fv.ANY_TYPE_TS], 0,
     "Avoid using 'any' in TypeScript; prefer specific types.",
     "Use explicit interfaces or generics."),
]


def security_rules() -> list[dict]:
    labels = [label for label, _ in fv.SECRET_PATTERNS]
    rows = []
    for detector, order, patterns, fold, message, suggestion, cwe, owasp, severity in _SECURITY:
        secret = detector == "hardcoded_secret"
        for k, pattern in enumerate(patterns):
            rows.append(_rule(
                family="issues", detector=detector, detector_ord=order, rule_ord=k + 1, pattern=pattern,
                ignore_case=fold, type=detector, category="security" if secret else None,
                label=labels[k] if secret else None, message=message, suggestion=suggestion, cwe=cwe, owasp=owasp,
                severity=severity))
    for k, pattern in enumerate(fv.GENERATED_MARKER_PATTERNS):
        rows.append(_rule(
            family="issues", detector="copilot_generated_code", detector_ord=8, rule_ord=k + 1, pattern=pattern,
            type="copilot_generated_code", message="Likely Copilot-generated code segment.",
            note="Likely Copilot-generated code segment", severity="warning"))
    return rows


def coding_rules() -> list[dict]:
    rows, order_in_detector = [], {}
    for detector, order, toggle, group_name, language, patterns, group, message, suggestion in _CODING:
        for pattern in patterns:
            key = (detector, group_name)
            order_in_detector[key] = order_in_detector.get(key, 0) + 1
            rows.append(_rule(
                family="coding", detector=detector, detector_ord=order, rule_ord=order_in_detector[key],
                lang_group=group_name, language=language, toggle=toggle, pattern=pattern, match_group=group,
                type=detector, message=message, suggestion=suggestion))
    return rows


def license_rules() -> list[dict]:
    return [
        _rule(family="license_ip", detector="license_detected", detector_ord=1, rule_ord=k + 1, pattern=pattern,
              ignore_case=True, match_group=1 if name == "spdx" else 0, type="license_detected",
              license=None if name == "spdx" else name,
              message="Detected {} license identifier in code.", severity="warning")
        for k, (name, pattern) in enumerate(fv.LICENSE_PATTERNS)
    ]


def restricted_rules(names: list[str] | None = None) -> list[dict]:
    """One rule per restricted name: a case-insensitive literal, reported once per file."""
    return [
        _rule(kind="restricted", family="license_ip", detector="restricted_license", detector_ord=2, rule_ord=k + 1,
              pattern=name, ignore_case=True, exists_only=True, type="restricted_license", license=name,
              message=f"Restricted license detected: {name}.", severity="blocking")
        for k, name in enumerate(fv.RESTRICTED_LICENSES if names is None else names)
    ]


def sector_rules() -> list[dict]:
    """The five sector packs; at most one finding per file, rule and pattern."""
    rows, count = [], {}
    for pack, rule_id, kind, severity, message, patterns in fv.SECTOR_RULES:
        count[pack] = count.get(pack, 0) + 1
        for k, pattern in enumerate(patterns):
            rows.append(_rule(
                pack=pack, kind="sector", family="sector", detector="sector", detector_ord=1, rule_ord=count[pack],
                pattern_ord=k + 1, pattern=pattern, exists_only=True, type=kind, rule_id=rule_id, message=message,
                severity=severity))
    return rows


def custom_rules(rules: list[dict]) -> list[dict]:
    """User coding rules: every match counts; missing fields take the documented defaults."""
    rows = []
    for r, rule in enumerate(rules):
        pattern = rule.get("pattern")
        if not pattern:
            continue
        for k, one in enumerate(pattern if isinstance(pattern, list) else [pattern]):
            rows.append(_rule(
                pack="custom", kind="custom", family="coding", detector="custom", detector_ord=5, rule_ord=r + 1,
                pattern_ord=k + 1, pattern=one, multiline=True, type=rule.get("type", "coding_standard"),
                message=rule.get("message", "Coding standard violation."), suggestion=rule.get("suggestion"),
                severity=rule.get("severity", "warning"), rule_id=rule.get("id")))
    return rows


def pack_rules(pack: str, rules: list[dict]) -> list[dict]:
    """User rules of one sector pack."""
    rows = []
    for r, rule in enumerate(rules):
        pattern = rule.get("pattern")
        for k, one in enumerate(pattern if isinstance(pattern, list) else [pattern]):
            if one:
                rows.append(_rule(
                    pack=pack, kind="sector", family="sector", detector="sector", detector_ord=1, rule_ord=r + 1,
                    pattern_ord=k + 1, pattern=one, exists_only=True, type=rule["type"], message=rule["message"],
                    severity=rule["severity"], rule_id=rule["id"]))
    return rows


def builtin_rules() -> list[dict]:
    return security_rules() + coding_rules() + license_rules()


def small_frame(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A driver-side dimension as a local relation: its exact size is known to the optimizer."""
    fields = StructType.fromDDL(schema)
    table = pa.Table.from_pylist([{f.name: r.get(f.name) for f in fields} for r in rows], schema=to_arrow_schema(fields))
    return spark.createDataFrame(table, schema=fields)


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules as a table."""
    return small_frame(spark, rules, RULE_SCHEMA)


def collect_rules(rules: DataFrame | list[dict]) -> list[dict]:
    """Rules of a table as driver-side rows, in rule order; of a table of more than ``PLAN_RULES`` rules one more than that."""
    if isinstance(rules, list):
        found = rules
    else:
        missing = [f for f in RULE_FIELDS if f not in rules.columns]
        full = rules.select("*", *[F.lit(None).alias(f) for f in missing])
        found = [row.asDict() for row in full.select(RULE_FIELDS).limit(PLAN_RULES + 1).collect()]
    return sorted(found, key=lambda r: (r["family"], r["detector_ord"], r["pack"], r["rule_ord"], r["pattern_ord"]))
