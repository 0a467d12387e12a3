"""Detectors over the derived corpus and the raw documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.corpus import CORPUS, DOCS, PAGES, _sql, corpus, docs, pages
from checks.registry import query
from codesieve import fixed_values as fv
from codesieve import rules as R
from codesieve.operators import detect, duplicates, licenses
from codesieve.functions import regex, text

GENERIC = "ext NOT IN ('.js', '.ts', '.jsx', '.tsx', '.java', '.go')"
LANG = {"generic": GENERIC, "js": "ext IN ('.js', '.ts', '.jsx', '.tsx')", "java": "ext = '.java'",
        "go": "ext = '.go'", "typescript": "ext IN ('.ts', '.tsx')"}


def spans(pattern: str, options: str = "", group: int = 0, where: str = "true", extra: str = "") -> str:
    """Oracle: all matches of one pattern with code-point offsets."""
    p = _sql(("(?i)" if options == "i" else "") + pattern)
    inner = f"regexp_extract_all(code, {p}, {group})"
    off = "instr(m[k], g[k]) - 1" if group else "0"
    return f"""SELECT path, m[k] AS match, g[k] AS grp,
  CAST(coalesce(list_sum(list_transform(s[1:k], lambda x: length(x))), 0)
   + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) + {off} AS INTEGER) AS start{extra}
 FROM (SELECT path, m, g, s, unnest(range(1, len(m) + 1)) AS k FROM
  (SELECT path, regexp_extract_all(code, {p}) AS m, {inner} AS g, regexp_split_to_array(code, {p}) AS s
   FROM files WHERE {where} AND regexp_matches(code, {p})))"""


def _security(name: str, patterns: list[str], severity: str, cwe, owasp, options: str = "", labels=None, type_name=None):
    parts = []
    for i, pattern in enumerate(patterns):
        label = _sql(labels[i]) if labels else "NULL"
        parts.append(spans(pattern, options, extra=f", {_sql(pattern)} AS pattern, {label} AS label"))
    sql = (
        f"WITH {CORPUS} SELECT path, '{type_name or name}' AS type, label, pattern, match, start,"
        f" CAST(start + length(match) AS INTEGER) AS stop, '{severity}' AS severity,"
        f" {_sql(cwe) if cwe else 'CAST(NULL AS VARCHAR)'} AS cwe, {_sql(owasp) if owasp else 'CAST(NULL AS VARCHAR)'} AS owasp"
        f" FROM ({' UNION ALL '.join(parts)})"
    )
    return sql


def _run_security(name):
    rules = [r for r in R.security_rules() if r["detector"] == name]

    def run(spark, sf):
        return detect.detect(corpus(spark, sf), rules).select(
            "path", "type", "label", "pattern", "match", "start", F.col("end").alias("stop"), "severity", "cwe", "owasp")

    return run


_SECURITY = [
    ("D1", "hardcoded_secret", [p for _, p in fv.SECRET_PATTERNS], "blocking", "CWE-798", "A02:2021", "", [l for l, _ in fv.SECRET_PATTERNS]),
    ("D2", "sql_injection_risk", fv.SQL_CONCAT_PATTERNS, "blocking", "CWE-89", "A03:2021", "i", None),
    ("D3", "insecure_deserialization", fv.DESERIALIZATION_PATTERNS, "warning", "CWE-502", "A08:2021", "", None),
    ("D4", "unsafe_execution", fv.UNSAFE_EXEC_PATTERNS, "warning", "CWE-78", "A01:2021", "", None),
    ("D5", "path_traversal_risk", fv.PATH_TRAVERSAL_PATTERNS, "warning", "CWE-22", "A01:2021", "i", None),
    ("D6", "unsafe_file_operation", fv.UNSAFE_FILE_PATTERNS, "warning", "CWE-73", "A01:2021", "i", None),
    ("D7", "insecure_crypto", fv.WEAK_CRYPTO_PATTERNS, "warning", "CWE-327", "A02:2021", "i", None),
    ("D8", "copilot_generated_code", fv.GENERATED_MARKER_PATTERNS, "warning", None, None, "", None),
]
for _id, _name, _patterns, _severity, _cwe, _owasp, _options, _labels in _SECURITY:
    query(f"{_id}_{_name}", _security(_name, _patterns, _severity, _cwe, _owasp, _options, _labels))(_run_security(_name))


def _all_security_sql() -> str:
    parts = []
    for _id, name, patterns, severity, *_rest in _SECURITY:
        options = _rest[2]
        for i, pattern in enumerate(patterns):
            parts.append(spans(pattern, options, extra=f", '{name}' AS type, '{severity}' AS severity"))
    return " UNION ALL ".join(parts)


@query("D9_copilot_insecure_suggestion", f"""WITH {CORPUS}, f AS ({_all_security_sql()}),
 gen AS (SELECT DISTINCT path FROM f WHERE type = 'copilot_generated_code')
 SELECT path, 'copilot_insecure_suggestion' AS type, type AS related_issue, start, CAST(start + length(match) AS INTEGER) AS stop,
  'warning' AS severity FROM f WHERE path IN (SELECT path FROM gen) AND type <> 'copilot_generated_code'""")
def _d9(spark, sf):
    files = corpus(spark, sf)
    found = detect.security(files)
    return found.where("detector_ord = 9").select("path", "type", "related_issue", "start", F.col("end").alias("stop"), "severity")


@query("A12_generated_files", f"""WITH {CORPUS} SELECT path, true AS is_generated FROM files WHERE """ + " OR ".join(
    f"regexp_matches(code, {_sql(p)})" for p in fv.GENERATED_MARKER_PATTERNS))
def _a12(spark, sf):
    return detect.generated_files(corpus(spark, sf)).where("is_generated").select("path", "is_generated")


def _coding_query(key: str, detector: str, lang: str, rows: list[tuple[str, int, str]], toggle_lang: str | None = None):
    """rows: (pattern, group, message template)."""
    parts = [spans(p, "", g, LANG[lang], f", {_sql(msg)} AS template") for p, g, msg in rows]
    sql = (
        f"WITH {CORPUS} SELECT path, '{detector}' AS type, replace(template, '{{}}', grp) AS message, start,"
        f" CAST(start + length(grp) AS INTEGER) AS stop FROM ({' UNION ALL '.join(parts)})"
    )
    chosen = [r for r in R.coding_rules() if r["detector"] == detector and (r["language"] or r["lang_group"]) == lang]

    def run(spark, sf):
        return detect.detect(corpus(spark, sf), chosen).select("path", "type", "message", "start", F.col("end").alias("stop"))

    query(key, sql)(run)


_coding_query("D10_naming_generic", "naming_convention", "generic", [(fv.NAMING_GENERIC, 1, "Function '{}' should be snake_case.")])
_coding_query("D11_naming_js", "naming_convention", "js",
              [(p, 1, "Identifier '{}' should be camelCase in JavaScript/TypeScript.") for p in fv.NAMING_JS])
_coding_query("D12_naming_java", "naming_convention", "java", [(fv.NAMING_JAVA, 1, "Method '{}' should be camelCase in Java.")])
_coding_query("D13_logging_generic", "logging_practice", "generic", [(fv.LOGGING_GENERIC, 0, "Use logging instead of print().")])
_coding_query("D14_logging_js", "logging_practice", "js",
              [(fv.LOGGING_JS, 0, "Use structured logging instead of console.* in production code.")])
_coding_query("D15_logging_java", "logging_practice", "java",
              [(fv.LOGGING_JAVA, 0, "Use a logger instead of System.out.println().")])
_coding_query("D16_logging_go", "logging_practice", "go",
              [(fv.LOGGING_GO, 0, "Use structured logging instead of fmt.Print* in production code.")])
_coding_query("D17_errors_generic", "error_handling", "generic",
              [(fv.BARE_EXCEPT, 0, "Avoid bare except; catch specific exceptions."),
               (fv.BROAD_EXCEPT, 0, "Avoid catching broad Exception; catch specific exceptions.")])
_coding_query("D18_errors_js", "error_handling", "js",
              [(fv.EMPTY_CATCH_JS, 0, "Avoid empty catch blocks; handle or rethrow the error.")])
_coding_query("D19_errors_java", "error_handling", "java",
              [(fv.BROAD_CATCH_JAVA, 0, "Avoid catching broad Exception; catch specific exceptions."),
               (fv.EMPTY_CATCH_JAVA, 0, "Avoid empty catch blocks; handle or rethrow the error.")])
_coding_query("D20_errors_go", "error_handling", "go",
              [(fv.IGNORED_ERROR_GO, 0, "Possible ignored error return value detected."),
               (fv.PANIC_GO, 0, "Avoid panic in application code; return errors instead.")])
_coding_query("D21_any_typescript", "coding_standard", "typescript",
              [(fv.ANY_TYPE_TS, 0, "Avoid using 'any' in TypeScript; prefer specific types.")])

CUSTOM = [
    {"id": "C-1", "pattern": ["^except", "TODO"], "message": "No except at line start.", "type": "house_rule", "severity": "blocking"},
    {"id": "C-2", "pattern": "passw[a-z]+"},
]


@query("D22_X1_custom_rules", f"""WITH {CORPUS}
 SELECT path, 'house_rule' AS type, 'No except at line start.' AS message, 'blocking' AS severity, 'C-1' AS rule_id, start,
  CAST(start + length(match) AS INTEGER) AS stop FROM ({spans('(?m)^except')} UNION ALL {spans('TODO')})
 UNION ALL SELECT path, 'coding_standard', 'Coding standard violation.', 'warning', 'C-2', start,
  CAST(start + length(match) AS INTEGER) FROM ({spans('passw[a-z]+')})""")
def _d22(spark, sf):
    return detect.detect(corpus(spark, sf), R.custom_rules(CUSTOM)).select(
        "path", "type", "message", "severity", "rule_id", "start", F.col("end").alias("stop"))


def _sector_sql(files: str, condition: str = "true") -> str:
    parts = [
        f"SELECT path, {_sql(pack)} AS pack, {_sql(rule_id)} AS rule_id, {_sql(kind)} AS type, {_sql(p)} AS pattern,"
        f" {_sql(severity)} AS severity FROM files WHERE regexp_matches(code, {_sql(p)})"
        for pack, rule_id, kind, severity, _msg, patterns in fv.SECTOR_RULES for p in patterns
    ]
    return f"WITH {files}, f AS ({' UNION ALL '.join(parts)}) SELECT * EXCLUDE (pack) FROM f WHERE {condition}"


@query("D23_sector_rules", _sector_sql(CORPUS))
def _d23(spark, sf):
    return detect.sector(corpus(spark, sf)).select("path", "rule_id", "type", "pattern", "severity")


@query("J1_files_match_rules", _sector_sql(CORPUS, "pack = 'telecom'"))
def _j1(spark, sf):
    rules = R.rules_frame(spark, R.sector_rules()).where("pack = 'telecom'")
    return detect.detect(corpus(spark, sf), rules).select("path", "rule_id", "type", "pattern", "severity")


def license_sql() -> str:
    parts = []
    for k, (name, pattern) in enumerate(fv.LICENSE_PATTERNS):
        value = "grp" if name == "spdx" else _sql(name)
        parts.append(f"SELECT batch_id, file_ord, path, {k + 1} AS rule_ord, license FROM (SELECT batch_id, file_ord, path, "
                     + (f"unnest(regexp_extract_all(code, {_sql('(?i)' + pattern)}, 1)) AS license" if value == "grp"
                        else f"unnest(list_transform(regexp_extract_all(code, {_sql('(?i)' + pattern)}), lambda x: {value})) AS license")
                     + " FROM files)")
    return " UNION ALL ".join(parts)


def _license_query(key, view, source):
    @query(key, f"""WITH {view}, f AS ({license_sql()}) SELECT path, license, 'license_detected' AS type,
     'Detected ' || license || ' license identifier in code.' AS message, 'warning' AS severity FROM f""")
    def run(spark, sf):
        return detect.licenses(source(spark, sf)).select("path", "license", "type", "message", "severity")


_license_query("D24_license_detected", CORPUS, corpus)
_license_query("D24_license_detected_pages", PAGES, pages)


@query("D25_restricted_license", f"WITH {CORPUS} " + " UNION ALL ".join(
    f"SELECT path, {_sql(n)} AS license, 'Restricted license detected: {n}.' AS message, 'blocking' AS severity"
    f" FROM files WHERE contains(lower(code), {_sql(n.lower())})" for n in fv.RESTRICTED_LICENSES))
def _d25(spark, sf):
    return detect.restricted(corpus(spark, sf)).select("path", "license", "message", "severity")


# --- duplicates ---------------------------------------------------------------------
# The given texts have no line separator but the line feed, and only plain blanks at line ends.

_LINES = """lines AS (SELECT batch_id, file_ord, path, k AS line, parts[k] AS txt FROM (
 SELECT batch_id, file_ord, path, parts, unnest(range(1, len(parts) + 1)) AS k FROM (
  SELECT batch_id, file_ord, path, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS parts FROM (
   SELECT batch_id, file_ord, path, string_split(code, chr(10)) AS p FROM files))))"""


def _snip(col: str, n: int) -> str:
    return f"CASE WHEN length({col}) > {n} THEN substr({col}, 1, {n}) || '...' ELSE {col} END"


@query("D26_W1_ip_duplication", f"""WITH {DOCS}, {_LINES},
 r AS (SELECT path, line, trim(txt) AS k, min(line) OVER (PARTITION BY path, trim(txt)) AS first FROM lines WHERE trim(txt) <> '')
 SELECT path, CAST(line AS INTEGER) AS line, CAST(first AS INTEGER) AS original_line, {_snip('k', 60)} AS snippet FROM r WHERE line > first""")
def _d26(spark, sf):
    return duplicates.duplicate_lines(docs(spark, sf)).select("path", "line", "original_line", "snippet")


def _blocks(view: str, n: int, chars: int) -> str:
    cols = " || chr(10) || ".join(
        f"lead(rtrim(txt), {i}) OVER w" if i else "rtrim(txt)" for i in range(n))
    return f"""{view}, {_LINES},
 b0 AS (SELECT batch_id, file_ord, path, line, trim({cols}, ' ' || chr(10)) AS k FROM lines WINDOW w AS (PARTITION BY batch_id, file_ord, path ORDER BY line)),
 b AS (SELECT * FROM b0 WHERE k IS NOT NULL AND length(k) >= {chars})"""


def _near(key, n, chars):
    @query(key, f"""WITH {_blocks(DOCS, n, chars)}, r AS (SELECT path, line, k, min(line) OVER (PARTITION BY path, k) AS first FROM b)
     SELECT path, CAST(line AS INTEGER) AS line, CAST(first AS INTEGER) AS original_line, {_snip('k', 80)} AS snippet FROM r WHERE line > first""")
    def run(spark, sf):
        return duplicates.near_duplicate_blocks(docs(spark, sf), n, chars).select("path", "line", "original_line", "snippet")


_near("D27_W2_ip_near_duplicate", 6, 240)
_near("D27_W2_three_line_blocks", 3, 120)


def _cross(key, n, chars):
    @query(key, f"""WITH {_blocks(DOCS, n, chars)},
     r AS (SELECT batch_id, path, line, k,
       first_value(path) OVER (PARTITION BY batch_id, k ORDER BY file_ord, line) AS original_file,
       first_value(line) OVER (PARTITION BY batch_id, k ORDER BY file_ord, line) AS original_line FROM b)
     SELECT path, CAST(line AS INTEGER) AS line, original_file, CAST(original_line AS INTEGER) AS original_line,
      {_snip('k', 80)} AS snippet FROM r WHERE path <> original_file""")
    def run(spark, sf):
        found = duplicates.cross_file_duplicates(docs(spark, sf), n, chars, unique_paths=True)
        return found.select("path", "line", "original_file", "original_line", "snippet")


_cross("D28_W3_J5_cross_file_duplicate", 6, 240)
_cross("D28_W3_three_line_blocks", 3, 120)


@query("D28_W3_two_pass_repeated_paths", f"""WITH {_blocks("base AS (SELECT source AS batch_id, doc_id AS file_ord, source || '/' || doc_id // 40 || '.txt' AS path, text AS code FROM documents), files AS (SELECT batch_id, first AS file_ord, path, code FROM (SELECT *, min(file_ord) OVER p AS first, max(file_ord) OVER p AS last FROM base WINDOW p AS (PARTITION BY batch_id, path)) WHERE file_ord = last)", 3, 120)},
 o AS (SELECT *, first_value(path) OVER w AS original_file, first_value(line) OVER w AS original_line FROM b WINDOW w AS (PARTITION BY batch_id, k ORDER BY file_ord, line))
 SELECT path, CAST(line AS INTEGER) AS line, original_file, CAST(original_line AS INTEGER) AS original_line FROM o WHERE path <> original_file""")
def _d28_two_pass(spark, sf):
    """Copies across files in two passes, where a path may come twice in a batch: its last text counts, at its first place."""
    files = docs(spark, sf).withColumn("path", F.concat("batch_id", F.lit("/"), F.floor(F.col("file_ord") / 40).cast("string"), F.lit(".txt")))
    return duplicates.cross_file_duplicates(files, 3, 120, two_pass=True).select("path", "line", "original_file", "original_line")


@query("D28_W3_one_batch", f"""WITH {_blocks("files AS (SELECT 'all' AS batch_id, doc_id AS file_ord, source || '/' || doc_id || '.txt' AS path, text AS code FROM documents)", 6, 240)},
 r AS (SELECT path, line, k,
   first_value(path) OVER (PARTITION BY k ORDER BY file_ord, line) AS original_file,
   first_value(line) OVER (PARTITION BY k ORDER BY file_ord, line) AS original_line FROM b)
 SELECT path, CAST(line AS INTEGER) AS line, original_file, CAST(original_line AS INTEGER) AS original_line,
  {_snip('k', 80)} AS snippet FROM r WHERE path <> original_file""")
def _one_batch(spark, sf):
    """All documents as one batch: the batch key does not spread anything."""
    files = docs(spark, sf).withColumn("batch_id", F.lit("all"))
    found = duplicates.cross_file_duplicates(files, unique_paths=True)
    return found.select("path", "line", "original_file", "original_line", "snippet")


# --- repository licenses --------------------------------------------------------------


@query("D29_J4_repo_licenses", f"""WITH {CORPUS}, f AS ({license_sql()}), n AS (SELECT DISTINCT batch_id, license FROM f)
 SELECT batch_id, license, 'repo_license_detected' AS type, 'Repository license detected: ' || license || '.' AS message,
  'warning' AS severity FROM n
 UNION ALL SELECT batch_id, license, 'restricted_license', 'Restricted license detected in repository: ' || license || '.', 'blocking'
  FROM n WHERE lower(license) IN ({', '.join(_sql(x.lower()) for x in fv.RESTRICTED_LICENSES)})""")
def _d29(spark, sf):
    return licenses.repo_licenses(corpus(spark, sf)).select("batch_id", "license", "type", "message", "severity")


_TWO_IDS = CORPUS.replace("text || chr(10) || snippet AS code", "text || chr(10) || snippet || CASE WHEN doc_id % 7 = 0 THEN ' SPDX-License-Identifier: Z-' || doc_id % 3 || ' SPDX-License-Identifier: A-1' ELSE '' END AS code")


@query("A8_distinct_licenses", f"""WITH {_TWO_IDS}, m AS (
  {" UNION ALL ".join(f"SELECT batch_id, file_ord, {k + 1} AS rule_ord, {'l' if name == 'spdx' else f'list_transform(l, lambda x: {_sql(name)})'} AS l FROM (SELECT batch_id, file_ord, regexp_extract_all(code, {_sql('(?i)' + p)}, {1 if name == 'spdx' else 0}) AS l FROM files)" for k, (name, p) in enumerate(fv.LICENSE_PATTERNS))}),
 f AS (SELECT batch_id, file_ord, rule_ord, unnest(l) AS license, generate_subscripts(l, 1) AS nth FROM m),
 n AS (SELECT batch_id, license, min({{'f': file_ord, 'r': rule_ord, 'a': nth}}) AS seen FROM f GROUP BY ALL)
 SELECT batch_id, license, row_number() OVER (PARTITION BY batch_id ORDER BY seen) AS position FROM n""")
def _a8(spark, sf):
    from pyspark.sql import Window

    k = F.col("file_ord")
    more = F.concat(F.lit(" SPDX-License-Identifier: Z-"), (k % 3).cast("string"), F.lit(" SPDX-License-Identifier: A-1"))
    names = licenses.license_names(corpus(spark, sf).withColumn("code", F.concat("code", F.when(k % 7 == 0, more).otherwise(""))))
    w = Window.partitionBy("batch_id").orderBy("seen")  # a batch has few distinct names
    return names.select("batch_id", "license", F.row_number().over(w).cast("bigint").alias("position"))


@query("F1_span_extraction", f"WITH {CORPUS} SELECT path, match, start FROM ({spans('[a-z]+_[a-z]+', '')})")
def _f1(spark, sf):
    p = regex.java_pattern("[a-z]+_[a-z]+")
    hits = corpus(spark, sf).select("path", F.expr(regex.spans_sql("code", regex.sql_str(p), mark=f"({regex.mark_sql('code')})")).alias("h"))
    return hits.select("path", F.inline_outer("h")).where("start is not null").select("path", F.col("m").alias("match"), F.col("start").cast("int").alias("start"))


@query("F2_regex_exists", f"WITH {CORPUS} SELECT path, regexp_matches(code, '(?i)log.*(imei|imsi)') AS found FROM files")
def _f2(spark, sf):
    p = regex.java_pattern("(?i)log.*(imei|imsi)")
    return corpus(spark, sf).select("path", F.col("code").rlike(p).alias("found"))


@query("F3_split_lines", f"WITH {DOCS}, {_LINES} SELECT path, count(*) AS n_lines, CAST(sum(length(txt)) AS BIGINT) AS n_chars FROM lines GROUP BY path")
def _f3(spark, sf):
    lines = text.split_lines(F.col("code"))
    return docs(spark, sf).select("path", lines.alias("l")).where(F.size("l") > 0).select(
        "path", F.size("l").cast("bigint").alias("n_lines"),
        F.aggregate("l", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x)).alias("n_chars"))


@query("F4_F5_strip_snippet", f"""WITH {PAGES} SELECT path, {_snip("trim(code, chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12))", 60)} AS snippet FROM files""")
def _f4(spark, sf):
    return pages(spark, sf).select("path", text.snippet(text.strip(F.col("code")), 60).alias("snippet"))


@query("F6_literal_search", f"WITH {DOCS} SELECT path, contains(lower(code), 'apache license, version 2.0') AS found FROM files")
def _f6(spark, sf):
    rule = R.restricted_rules(["Apache License, Version 2.0"])
    files = docs(spark, sf)
    hit = detect.detect(files, rule).select("path", F.lit(True).alias("found"))
    return files.select("path").join(hit, "path", "left").select("path", F.coalesce("found", F.lit(False)).alias("found"))
