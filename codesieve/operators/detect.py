"""Pattern detectors: one row-local pass over the text, no shuffle.

Stage 1 finds, per file, the rules whose gate (required literals, language, toggles) holds.
Stage 2 runs one span expression with the pattern as a column, for those rules only.  The rule
table is a checked, broadcast dimension, so both stages stay in the task that read the file.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve import rules as R
from codesieve.functions import pattern, regex, text
from codesieve.operators.findings import as_findings, union_findings

KEYS = ["batch_id", "file_ord", "path"]
_SPAN = "struct<m:string,g:string,start:int,end:int,line:int>"
HOW = "mode string, java string, own int, before array<int>, after array<int>"
META = ["family", "detector", "detector_ord", "rule_ord", "pattern_ord", "type", "category", "label", "rule_id",
         "license", "message", "suggestion", "note", "cwe", "owasp", "severity", "pattern"]


def _applies(rule: dict, columns: list[str]) -> list[str]:
    """Language group, language, toggle and sector conditions of a rule."""
    parts = []
    if rule["lang_group"]:
        parts.append(f"lang_group = {regex.sql_str(rule['lang_group'])}")
    if rule["language"]:
        parts.append(f"lower(language) = {regex.sql_str(rule['language'])}")
    if rule["toggle"] and "toggles" in columns:
        parts.append(f"coalesce(toggles.{rule['toggle']}, true)")
    if rule["kind"] == "sector" and "sector" in columns:
        parts.append(f"sector = {regex.sql_str(rule['pack'])}")
    return parts


def _gate(rule: dict) -> str:
    """Text condition of a rule; it decides the rules of mode ``sure``."""
    if rule["kind"] == "restricted":
        quoted = regex.sql_str("(?iu)\\Q" + rule["pattern"] + "\\E")
        if not rule["pattern"].isascii():
            return f"rlike(code, {quoted})"
        return f"(contains(hay, {regex.sql_str(rule['pattern'].lower())}) OR (odd AND rlike(code, {quoted})))"
    return regex.gate_sql(rule["pattern"], bool(rule["ignore_case"]))[0]


_MARKERS = [p.removeprefix("(?i)") for p in fv.GENERATED_MARKER_PATTERNS]


def _marker_sql(tokens: dict[str, str]) -> str:
    """True when a marker phrase of generated code occurs."""
    parts = []
    for phrase in _MARKERS:
        java = regex.sql_str(regex.java_pattern(phrase, ignore_case=True))
        seen = regex.token_condition([tokens[phrase]], list(tokens.values()))
        parts.append(f"({seen} AND contains(hay, {regex.sql_str(phrase.lower())})) OR (odd AND rlike(code, {java}))")
    return " OR ".join(parts)


def _prepared(files: DataFrame, tokens: dict[str, str], *columns: Column | str) -> DataFrame:
    """Lower-cased text (hay), whether it holds letters with odd folds, and the tokens that occur in it.

    One scan for the tokens of all rules replaces a search per rule; most rules stop here.
    """
    odd = reduce(or_, [F.contains("code", F.lit(c)) for c in regex.ODD_FOLDS])
    lowered = files.select(*KEYS, "code", *columns, F.lower("code").alias("hay"), odd.alias("odd"))
    scan = F.regexp_extract_all("hay", F.lit(regex.token_scan_regex(list(tokens.values()))), F.lit(1))
    return lowered.withColumn("found", F.array_distinct(scan))


def compiled(rule: dict) -> dict:
    """How a rule runs: ``mode``, the Java pattern, the groups around the asked one, and why it runs in Python, if so."""
    out = {"mode": "sure", "java": None, "own": 0, "before": [], "after": [], "reason": None}
    if rule["kind"] == "restricted":
        return out
    flags, group = regex.flags_of(bool(rule["ignore_case"]), bool(rule["multiline"])), rule["match_group"] or 0
    if rule["exists_only"]:
        try:
            sufficient = regex.gate_sql(rule["pattern"], bool(rule["ignore_case"]))[1]
            return out | {"mode": "sure" if sufficient else "exists", "java": pattern.translate(rule["pattern"], flags).java}
        except pattern.Untranslatable as e:
            return out | {"mode": "twin", "reason": str(e)}
    reason = pattern.python_reason(rule["pattern"], flags, group)
    if reason:
        return out | {"mode": "twin", "reason": reason}
    found = pattern.translate(rule["pattern"], flags, group)
    return out | {"mode": "spans", "java": found.java, "own": found.own, "before": list(found.before), "after": list(found.after)}


def twin_rows(compiled_pattern: re.Pattern, group: int, exists_only: bool, code: str) -> list[tuple]:
    """(m, g, start, end, line) of Python's matches; one empty row for a rule that asks for existence only.

    Line feeds are counted from match to match, so the work is linear in the text.
    """
    if exists_only:
        return [(None, None, None, None, None)] if compiled_pattern.search(code) else []
    out, line, at = [], 1, 0
    for m in compiled_pattern.finditer(code):
        begin = m.start(group)
        if begin >= at:
            line += code.count("\n", at, begin)
            at = begin
        here = line if begin >= at else code.count("\n", 0, max(begin, 0)) + 1
        out.append((m.group(0), m.group(group), begin, m.end(group), here))
    return out


def twin_hits(gated: DataFrame, rules: list[tuple[int, dict]]) -> DataFrame:
    """Rules whose spans Java cannot give, by Python's ``re``."""
    how = {ix: (re.compile(r["pattern"], regex.flags_of(bool(r["ignore_case"]), bool(r["multiline"]))), r["match_group"] or 0, bool(r["exists_only"])) for ix, r in rules}

    def scan(batches):
        for pdf in batches:
            out = [(batch_id, file_ord, path, generated, ix, *row)
                   for batch_id, file_ord, path, generated, ix, code in zip(pdf.batch_id, pdf.file_ord, pdf.path, pdf.generated, pdf.rule_ix, pdf.code)
                   for row in twin_rows(*how[ix], code)]
            frame = pd.DataFrame(out, columns=["batch_id", "file_ord", "path", "generated", "rule_ix", "m", "g", "start", "end", "line"])
            yield frame.astype({c: "Int32" for c in ("start", "end", "line")})

    schema = ("batch_id string, file_ord bigint, path string, generated boolean, rule_ix int, m string, g string, start int,"
              " end int, line int")
    return gated.select(*KEYS, "generated", "rule_ix", "code").where("code is not null").mapInPandas(scan, schema)


def rule_hits(files: DataFrame, rules: list[dict]) -> DataFrame:
    """One row per hit: file keys, ``generated``, ``rule_ix`` and the span (m, g, start, end, line)."""
    columns = files.columns
    language = text.guess_language(F.col("path"), F.col("language") if "language" in columns else None)
    per_rule = [
        ([r["pattern"]] if r["pattern"].isascii() else None) if r["kind"] == "restricted" else regex.token_literals(r["pattern"])
        for r in rules
    ]
    tokens = regex.choose_tokens([lit for literals in per_rule for lit in literals or []] + _MARKERS)
    prepared = _prepared(
        files.withColumn("language", language), tokens, "language", text.language_group(F.col("language")).alias("lang_group"),
        *[c for c in ("toggles", "sector", "ai_generated") if c in columns])
    how, candidates, twins = [], [], []
    for ix, rule in enumerate(rules):
        gate = _gate(rule)
        wanted = [tokens[lit] for lit in per_rule[ix] or []]
        seen = [f"(odd OR {regex.token_condition(wanted, list(tokens.values()))})"] if wanted else []
        condition = " AND ".join([*_applies(rule, columns), *seen, *([] if gate == "true" else [gate])]) or "true"
        candidates.append(f"CASE WHEN {condition} THEN {ix} END")
        found = compiled(rule)
        if found["mode"] == "twin":
            twins.append((ix, rule))
        how.append({"rule_ix": ix, **found})
    said = F.coalesce(F.col("ai_generated"), F.lit(False)) if "ai_generated" in columns else F.lit(False)
    # decided before the explode, once per file and in compiled code; only the text goes on
    decided = prepared.select(
        *KEYS, "code", (said | F.expr(_marker_sql(tokens))).alias("generated"), F.expr(regex.mark_sql("code")).alias("mark"),
        F.expr(f"array_compact(array({', '.join(candidates)}))").alias("wanted"))
    # outer: an inner explode makes the optimizer copy the whole gate array into a size() > 0 filter
    gated = decided.select(*KEYS, "code", "generated", "mark", F.explode_outer("wanted").alias("rule_ix")).where("rule_ix is not null")
    modes = R.small_frame(files.sparkSession, how, "rule_ix int, " + HOW)
    hits = native_hits(gated.join(F.broadcast(modes), "rule_ix"), bool(twins))  # at most R.PLAN_RULES rows
    if not twins:
        return hits
    return union_findings(hits, twin_hits(gated.where(F.col("rule_ix").isin([ix for ix, _ in twins])), twins))


def native_hits(rows: DataFrame, twins: bool) -> DataFrame:
    """Spans of candidate rows: file keys, code, ``generated``, ``mark``, ``rule_ix`` and the rule's form (``HOW``).

    With ``twins``, rows of rules that run in Python may be among them and are left out.
    """
    once = "array(named_struct('m', cast(null as string), 'g', cast(null as string), 'start', cast(null as int), 'end', cast(null as int), 'line', cast(null as int)))"
    spans = F.expr(
        f"CASE mode WHEN 'sure' THEN {once} WHEN 'exists' THEN CASE WHEN rlike(code, java) THEN {once} END"
        f" WHEN 'spans' THEN {regex.spans_sql('code', 'java', 'own', 'before', 'after')} END").cast(f"array<{_SPAN}>")
    hits = rows.select(*KEYS, "generated", "rule_ix", "mode", spans.alias("spans"))
    if twins:
        hits = hits.where("mode <> 'twin'")
    return hits.select(*KEYS, "generated", "rule_ix", F.posexplode_outer("spans").alias("at", "h")).where("at is not null").select(
        *KEYS, "generated", "rule_ix", "h.*")


def _with_suggestions(hits: DataFrame) -> DataFrame:
    """Add one suggestion row after each security hit in generated code, in place."""
    echo = F.col("generated") & (F.col("family") == "issues") & (F.col("detector") != "copilot_generated_code") & F.col(
        "severity").isin("warning", "blocking")
    copies = F.when(echo, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return hits.withColumn("derived", F.explode(copies))


def detect(files: DataFrame, rules: DataFrame | list[dict], flag_generated: bool = False) -> DataFrame:
    """Findings of a rule table over files.

    ``files`` needs batch_id, file_ord, path and code; optional are language, a ``toggles`` struct
    of booleans, ``sector`` (then sector rules only apply to files of their pack), and
    ``ai_generated``.  With ``flag_generated``, security findings of generated files are marked
    strict and each gets a suggestion row, which is not strict itself.  A file counts as generated
    when a marker phrase occurs in it or ``ai_generated`` says so.

    Up to ``R.PLAN_RULES`` rules are part of the plan; a longer table is searched by automaton (``repository.detect_table``),
    with the same findings.
    """
    found = R.collect_rules(rules)
    if len(found) > R.PLAN_RULES:
        from codesieve.operators import repository

        return repository.detect_table(files, rules if isinstance(rules, DataFrame) else R.rules_frame(files.sparkSession, found), flag_generated)
    meta = R.small_frame(files.sparkSession, [{**r, "rule_ix": ix} for ix, r in enumerate(found)], "rule_ix int, " + R.RULE_SCHEMA)
    return findings_of_hits(rule_hits(files, found).join(F.broadcast(meta.select("rule_ix", *META)), "rule_ix"), flag_generated)


def findings_of_hits(hits: DataFrame, flag_generated: bool = False) -> DataFrame:
    """Findings of hits that carry their rule's columns (``META``)."""
    spoken = F.coalesce(F.col("license"), F.col("g"))
    security = F.col("family") == "issues"
    placed = F.col("family") != "license_ip"
    values: dict[str, Column] = {
        "match": F.when(security, F.col("m")),
        "pattern": F.when(security | (F.col("family") == "sector"), F.col("pattern")),
        "start": F.when(placed, F.col("start")),
        "end": F.when(placed, F.col("end")),
        "line": F.lit(None),
        "at_line": F.when(placed, F.col("line")),
        "license": F.when(F.col("family") == "license_ip", spoken),
        "message": F.replace("message", F.lit("{}"), F.coalesce(spoken, F.lit(""))),
    }
    if not flag_generated:
        return as_findings(hits, **values)
    both = _with_suggestions(hits)
    derived, strict = F.col("derived"), F.when(security & F.col("generated"), True)
    told = {
        "detector": "copilot_insecure_suggestion", "detector_ord": 9, "type": "copilot_insecure_suggestion", "severity": "warning",
        "message": "Copilot-generated code triggered a security rule.",
        # suggestion rows follow in the order of their findings
        "rule_ord": F.col("detector_ord") * 1000 + F.col("rule_ord"), "related_issue": F.col("type"), "copilot_generated": True,
    }
    values.update(copilot_strict=strict, copilot_generated=strict, related_issue=F.lit(None).cast("string"))
    for name in ("category", "label", "rule_id", "suggestion", "note", "cwe", "owasp", "match", "pattern", "license", "copilot_strict", *told):
        value = told.get(name)
        shown = value if isinstance(value, Column) else F.lit(value)
        values[name] = F.when(derived, shown).otherwise(values.get(name, F.col(name) if name in both.columns else F.lit(None)))
    return as_findings(both, **values)


def security(files: DataFrame) -> DataFrame:
    """Security findings with the marks and suggestion rows for generated code."""
    return detect(files, R.security_rules(), flag_generated=True)


def coding(files: DataFrame, custom: list[dict] | None = None) -> DataFrame:
    return detect(files, R.coding_rules() + R.custom_rules(custom or []))


def licenses(files: DataFrame) -> DataFrame:
    return detect(files, R.license_rules())


def restricted(files: DataFrame, names: list[str] | None = None) -> DataFrame:
    return detect(files, R.restricted_rules(names))


def sector(files: DataFrame, rules: DataFrame | list[dict] | None = None) -> DataFrame:
    return detect(files, R.sector_rules() if rules is None else rules)


def generated_files(files: DataFrame) -> DataFrame:
    """(file keys, is_generated): any marker phrase in the text, or said so by its batch."""
    columns = files.columns
    said = F.coalesce(F.col("ai_generated"), F.lit(False)) if "ai_generated" in columns else F.lit(False)
    tokens = regex.choose_tokens(_MARKERS)
    prepared = _prepared(files, tokens, said.alias("said"))
    return prepared.select(*KEYS, (F.col("said") | F.expr(_marker_sql(tokens))).alias("is_generated"))
