"""The scan and what follows it."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.corpus import CORPUS, _sql, corpus, table
from checks.detection import LANG, _all_security_sql, _blocks, _snip, license_sql, spans
from checks.registry import query
from codesieve import fixed_values as fv
from codesieve import rules as R
from codesieve.operators import detect, duplicates, enrich, fixes, licenses, options, policy, reports, selection
from codesieve.plans.scan import ScanOptions, findings_of, scan, verdicts

OPTIONS = ScanOptions(unique_paths=True)


def _coding_all() -> str:
    parts = []
    for r in R.coding_rules():
        where = LANG[r["language"] or r["lang_group"]]
        parts.append("SELECT path, '" + r["type"] + "' AS type FROM (" + spans(r["pattern"], "", r["match_group"], where) + ")")
    return " UNION ALL ".join(parts)


def _restricted() -> str:
    return " UNION ALL ".join(
        f"SELECT path FROM files WHERE contains(lower(code), {_sql(n.lower())})" for n in fv.RESTRICTED_LICENSES)


def _sector(pack: str = "finance") -> str:
    return " UNION ALL ".join(
        f"SELECT path, '{kind}' AS type FROM files WHERE regexp_matches(code, {_sql(p)})"
        for name, _id, kind, _sev, _msg, patterns in fv.SECTOR_RULES if name == pack for p in patterns)


# All findings of the derived corpus as (batch_id, path, family, type, severity, strict)
ALL = f"""{_blocks(CORPUS, 6, 240)},
 sec AS ({_all_security_sql()}),
 gen AS (SELECT DISTINCT path FROM sec WHERE type = 'copilot_generated_code'),
 dl AS (SELECT path, line, min(line) OVER (PARTITION BY path, trim(txt)) AS first FROM lines WHERE trim(txt) <> ''),
 nd AS (SELECT path, line, min(line) OVER (PARTITION BY path, k) AS first,
   first_value(path) OVER (PARTITION BY batch_id, k ORDER BY file_ord, line) AS origin FROM b),
 f0 AS (
  SELECT path, 'issues' AS family, type, severity, path IN (SELECT path FROM gen) AS strict FROM sec
  UNION ALL SELECT path, 'issues', 'copilot_insecure_suggestion', 'warning', false FROM sec
    WHERE path IN (SELECT path FROM gen) AND type <> 'copilot_generated_code'
  UNION ALL SELECT path, 'coding', type, NULL, false FROM ({_coding_all()})
  UNION ALL SELECT path, 'license_ip', 'license_detected', 'warning', false FROM ({license_sql()})
  UNION ALL SELECT path, 'license_ip', 'restricted_license', 'blocking', false FROM ({_restricted()})
  UNION ALL SELECT path, 'license_ip', 'ip_duplication', 'warning', false FROM dl WHERE line > first
  UNION ALL SELECT path, 'license_ip', 'ip_near_duplicate', 'warning', false FROM nd WHERE line > first
  UNION ALL SELECT path, 'license_ip', 'ip_cross_file_duplicate', 'warning', false FROM nd WHERE path <> origin
  UNION ALL SELECT path, 'sector', type, 'blocking', false FROM ({_sector()})),
 policy(type, level) AS (VALUES {', '.join(f"({_sql(k)}, {_sql(v)})" for k, v in fv.DEFAULT_POLICY.items())}),
 f AS (SELECT split_part(path, '/', 1) AS batch_id, f0.*, CASE WHEN strict AND l = 'advisory' THEN 'warning'
   WHEN strict AND l = 'warning' THEN 'blocking' ELSE l END AS policy_level
  FROM (SELECT f0.*, coalesce(level, 'advisory') AS l FROM f0 LEFT JOIN policy USING (type)) AS f0),
 rank AS (SELECT files.batch_id, files.file_ord, files.path, coalesce(max(CASE policy_level WHEN 'blocking' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END), 0) AS r
  FROM files LEFT JOIN f ON files.path = f.path GROUP BY ALL),
 verdict AS (SELECT batch_id, file_ord, path, CASE r WHEN 2 THEN 'blocking' WHEN 1 THEN 'warning' ELSE 'advisory' END AS policy FROM rank)"""

FAMILY_SQL = ", ".join(f"count(*) FILTER (family = '{f}') AS {c}" for f, _, c in fv.FAMILIES)


def _scan(spark, sf):
    return scan(corpus(spark, sf), options=OPTIONS)


@query("U1_all_findings", f"WITH {ALL} SELECT path, family, type, severity, strict, count(*) AS n FROM f GROUP BY ALL")
def _u1(spark, sf):
    found = findings_of(corpus(spark, sf), OPTIONS)
    return found.groupBy("path", "family", "type", "severity", F.coalesce("copilot_strict", F.lit(False)).alias("strict")).agg(F.count("*").alias("n"))


@query("J2_policy_levels", f"WITH {ALL} SELECT path, type, policy_level, count(*) AS n FROM f GROUP BY ALL")
def _j2(spark, sf):
    return _scan(spark, sf).groupBy("path", "type", "policy_level").agg(F.count("*").alias("n"))


@query("J3_guideline_links", f"""WITH {ALL}, links(type, url) AS (VALUES {', '.join(f"({_sql(k)}, {_sql(v)})" for k, v in fv.GUIDELINE_LINKS.items())})
 SELECT family, type, url AS guideline_url, count(*) AS n FROM f LEFT JOIN links USING (type) GROUP BY ALL""")
def _j3(spark, sf):
    return _scan(spark, sf).groupBy("family", "type", "guideline_url").agg(F.count("*").alias("n"))


@query("A1_P15_file_verdict", f"WITH {ALL} SELECT path, policy, policy = 'blocking' AS override_allowed FROM verdict")
def _a1(spark, sf):
    files = corpus(spark, sf)
    per_file, _ = verdicts(files, scan(files, options=OPTIONS))
    return per_file.select("path", "policy", "override_allowed")


_BATCH = """SELECT batch_id, CASE max(CASE policy WHEN 'blocking' THEN 2 WHEN 'warning' THEN 1 ELSE 0 END) WHEN 2 THEN 'blocking'
 WHEN 1 THEN 'warning' ELSE 'advisory' END AS policy, bool_or(policy = 'blocking') AS override_allowed, count(*) AS files_scanned FROM verdict GROUP BY batch_id"""


@query("A2_A9_batch_verdict", f"WITH {ALL} {_BATCH}")
def _a2(spark, sf):
    files = corpus(spark, sf)
    return verdicts(files, scan(files, options=OPTIONS))[1]


@query("J12_repo_license_verdict", f"""WITH {ALL}, names AS (SELECT DISTINCT batch_id, license FROM ({license_sql()})),
 repo AS (SELECT batch_id, max(CASE WHEN lower(license) IN ({', '.join(_sql(x.lower()) for x in fv.RESTRICTED_LICENSES)}) THEN 2 ELSE 1 END) AS rr FROM names GROUP BY ALL)
 SELECT path, CASE greatest(r, coalesce(rr, 0)) WHEN 2 THEN 'blocking' WHEN 1 THEN 'warning' ELSE 'advisory' END AS policy FROM rank LEFT JOIN repo USING (batch_id)""")
def _j12(spark, sf):
    files = corpus(spark, sf)
    return verdicts(files, scan(files, options=OPTIONS, license_texts=files))[0].select("path", "policy")


@query("J12_repo_license_per_file", f"""WITH {CORPUS}, names AS (SELECT DISTINCT batch_id, license FROM ({license_sql()}))
 SELECT path, license, 'repo_license_detected' AS type FROM files JOIN names USING (batch_id)
 UNION ALL SELECT path, license, 'restricted_license' FROM files JOIN names USING (batch_id)
 WHERE lower(license) IN ({', '.join(_sql(x.lower()) for x in fv.RESTRICTED_LICENSES)})""")
def _j12b(spark, sf):
    files = corpus(spark, sf)
    return enrich.repo_licenses_per_file(files, licenses.repo_licenses(files)).select("path", "license", "type")


@query("J11_cross_file_per_path", f"""WITH {_blocks(CORPUS, 3, 120)}, r AS (SELECT path,
  first_value(path) OVER (PARTITION BY batch_id, k ORDER BY file_ord, line) AS origin FROM b)
 SELECT path, count(*) AS cross_file FROM r WHERE path <> origin GROUP BY path""")
def _j11(spark, sf):
    files = corpus(spark, sf)
    lines = duplicates.duplicate_lines(files)
    both = enrich.add_cross_file(lines, duplicates.cross_file_duplicates(files, 3, 120, unique_paths=True))
    counted = both.groupBy("path").agg(F.count_if(F.col("type") == "ip_cross_file_duplicate").alias("cross_file"))
    return counted.where("cross_file > 0")


@query("A6_batch_totals", f"WITH {ALL} SELECT batch_id, {FAMILY_SQL} FROM f GROUP BY batch_id")
def _a6(spark, sf):
    files = corpus(spark, sf)
    batches = files.select("batch_id").distinct()
    return enrich.batch_totals(batches, findings_of(files, OPTIONS))


@query("A5_A11_nested_counts", f"""WITH {ALL} SELECT files.path, {', '.join(f"count(*) FILTER (family = '{fam}') AS {c}" for fam, _, c in fv.FAMILIES)}
 FROM files LEFT JOIN f ON files.path = f.path GROUP BY files.path""")
def _a5(spark, sf):
    files = corpus(spark, sf)
    nested = enrich.nest_findings(files, findings_of(files, OPTIONS))
    counts = nested.select("path", enrich.output_counts(nested).alias("c"))
    return counts.select("path", *[F.col(f"c.{c}").cast("bigint").alias(c) for _, _, c in fv.FAMILIES])


@query("P12_has_findings", f"WITH {ALL} SELECT files.path, count(f.type) > 0 AS found FROM files LEFT JOIN f ON files.path = f.path GROUP BY files.path")
def _p12(spark, sf):
    files = corpus(spark, sf)
    nested = enrich.nest_findings(files, findings_of(files, OPTIONS))
    return nested.select("path", selection.has_findings(nested).alias("found"))


@query("A7_remaining_counts", f"""WITH {ALL}, c AS (SELECT {', '.join(f"count(*) FILTER (family = '{fam}') AS {name}" for fam, name, _ in fv.FAMILIES)},
  CAST(0 AS BIGINT) AS errors, count(*) AS total FROM f) SELECT *, CASE WHEN total > 0 THEN 2 ELSE 0 END AS exit_code FROM c""")
def _a7(spark, sf):
    return reports.remaining(findings_of(corpus(spark, sf), OPTIONS))


_FIXED = CORPUS.replace("files AS (", "base AS (") + """, files AS (SELECT * REPLACE (CASE WHEN ext = '.py' THEN replace(code, 'print(', 'logger.info(') ELSE code END AS code) FROM base)"""


@query("K1_K5_J10_A7_fix_and_rescan", f"""WITH {_FIXED}, sec AS ({_all_security_sql()}), cod AS ({_coding_all()})
 SELECT (SELECT count(*) FROM sec) AS issues, (SELECT count(*) FROM cod) AS coding_issues, (SELECT count(*) FROM base WHERE ext = '.py' AND contains(code, 'print(')) AS rewritten,
  (SELECT count(*) FROM base WHERE ext = '.py' AND contains(code, 'print(')) AS saved, CASE WHEN (SELECT count(*) FROM sec) + (SELECT count(*) FROM cod) > 0 THEN 2 ELSE 0 END AS exit_code""")
def _fix_and_rescan(spark, sf):
    """Scan, rewrite what has findings, scan that again, and report what is left: from one store with two generations."""
    from checks.logs import scratch
    from codesieve.plans import rewrite as rw

    def scanner(files):
        return detect.detect(files, R.security_rules() + R.coding_rules())

    def rewriter(files):
        due = F.col("path").endswith(".py") & F.contains("code", F.lit("print("))
        return files.withColumn("original", F.col("code")).withColumn("changes", F.when(due, F.array(F.lit("logger"))).otherwise(F.array().cast("array<string>"))).withColumn(
            "code", F.when(due, F.replace("code", F.lit("print("), F.lit("logger.info("))).otherwise(F.col("code")))

    folder = scratch(spark) + "/store"
    rw.scan_into(corpus(spark, sf), folder, scanner)
    rw.rewrite(spark, folder, rewriter, scanner)
    saved = rw.backups(spark, folder).where(F.contains("code", F.lit("print("))).count()
    return rw.report(spark, folder).select("issues", "coding_issues", "rewritten", F.lit(saved).cast("bigint").alias("saved"), "exit_code")


@query("A13_breakdown", f"WITH {ALL} SELECT type, severity, batch_id, count(*) AS n, grouping(type, severity, batch_id) AS grouping FROM f GROUP BY CUBE (type, severity, batch_id)")
def _a13(spark, sf):
    return reports.breakdown(findings_of(corpus(spark, sf), OPTIONS), ["type", "severity", "batch_id"])


@query("P6_redacted_findings", f"WITH {ALL} SELECT path, type, count(*) AS n, 0 AS n_secret_fields FROM f WHERE family = 'issues' GROUP BY ALL")
def _p6(spark, sf):
    files = corpus(spark, sf)
    redacted = enrich.redact_findings(detect.security(files))
    left = len([c for c in redacted.columns if c in fv.REDACTED_FIELDS])
    return redacted.groupBy("path", "type").agg(F.count("*").alias("n"), F.lit(left).alias("n_secret_fields"))


@query("P6_redacted_nested", f"WITH {ALL} SELECT files.path, count(f.type) AS n, false AS has_match FROM files LEFT JOIN f ON files.path = f.path AND family = 'issues' GROUP BY files.path")
def _p6b(spark, sf):
    files = corpus(spark, sf)
    nested = enrich.redact_nested(enrich.nest_findings(files, detect.security(files)))
    names = nested.schema["issues"].dataType.elementType.names
    return nested.select("path", F.size("issues").cast("bigint").alias("n"), F.lit("match" in names).alias("has_match"))


@query("P5_redacted_request", f"WITH {CORPUS} SELECT path, '<redacted>' AS code, '<redacted>' AS ai_api_key, length(code) AS size FROM files")
def _p5(spark, sf):
    files = corpus(spark, sf)
    requests = files.select("path", "code", F.lit("k").alias("ai_api_key"), F.array(F.struct("path", "code")).alias("files"))
    out = enrich.redact_request(requests)
    return out.select("path", "code", "ai_api_key", F.col("files")[0]["size"].cast("bigint").alias("size"))


# Batch options derived from the documents: one row per source.
_OPT = """opt AS (SELECT DISTINCT source AS batch_id, CAST(replace(source, 'src', '') AS INTEGER) AS n FROM documents),
 pol AS (SELECT batch_id, n, n % 4 = 1 AS ai_generated, n % 4 = 0 AS has_request FROM opt)"""


def batch_options(spark, sf):
    base = table(spark, sf, "documents").select(F.col("source").alias("batch_id")).distinct()
    n = F.regexp_replace("batch_id", "src", "").cast("int")
    request = F.when(n % 4 == 0, policy.policy_map({"error_handling": "blocking", "license_detected": "advisory"}))
    generated = n % 4 == 1
    return base.select(
        "batch_id", n.alias("n"), generated.alias("ai_generated"),
        policy.effective_policy(request, generated, policy.policy_map(fv.DEFAULT_POLICY)).alias("policy"),
        (n % 3 != 0).alias("copilot_strict"),
        F.when(n % 5 == 0, F.lit(False)).alias("config_override_allowed"),
        F.when(n % 2 == 0, F.lit(False)).alias("stored_override_allowed"))


@query("P14_effective_policy", f"""WITH {_OPT}, types(type, level) AS (VALUES {', '.join(f"({_sql(k)}, {_sql(v)})" for k, v in fv.DEFAULT_POLICY.items())})
 SELECT batch_id, type, CASE WHEN has_request THEN CASE type WHEN 'error_handling' THEN 'blocking' ELSE 'advisory' END
  WHEN ai_generated AND type = 'copilot_generated_code' THEN 'blocking' ELSE level END AS level
 FROM pol CROSS JOIN types WHERE NOT has_request OR type IN ('error_handling', 'license_detected')""")
def _p14(spark, sf):
    return batch_options(spark, sf).select("batch_id", F.explode("policy").alias("type", "level"))


@query("A1_batch_policies", f"""WITH {ALL}, {_OPT}, g AS (SELECT f.path, f.family, f.type, pol.n,
   f.type = 'copilot_generated_code' AS marker,
   CASE WHEN has_request THEN CASE f.type WHEN 'error_handling' THEN 'blocking' ELSE 'advisory' END
    WHEN ai_generated AND f.type = 'copilot_generated_code' THEN 'blocking'
    ELSE coalesce((SELECT level FROM policy p WHERE p.type = f.type), 'advisory') END AS base,
   f.strict AND pol.n % 3 <> 0 AS bump FROM f JOIN pol USING (batch_id)),
  h AS (SELECT path, max(CASE WHEN base = 'blocking' THEN 2 WHEN base = 'warning' THEN CASE WHEN bump THEN 2 ELSE 1 END ELSE CASE WHEN bump THEN 1 ELSE 0 END END) AS r FROM g GROUP BY path)
 SELECT files.path, CASE coalesce(r, 0) WHEN 2 THEN 'blocking' WHEN 1 THEN 'warning' ELSE 'advisory' END AS policy,
  coalesce(r, 0) = 2 AND coalesce(CASE WHEN n % 5 = 0 THEN false END, CASE WHEN n % 2 = 0 THEN false END, true) AS override_allowed
 FROM files JOIN pol USING (batch_id) LEFT JOIN h ON files.path = h.path""")
def _a1b(spark, sf):
    files, batches = corpus(spark, sf), batch_options(spark, sf)
    found = scan(files, batches=batches, options=OPTIONS)
    return policy.file_verdict(files, found, batches).select("path", "policy", "override_allowed")


@query("J10_rescan_upsert", f"""WITH {CORPUS}, s AS ({_all_security_sql()})
 SELECT path, type, count(*) AS n FROM s JOIN documents d ON d.source || '/' || d.doc_id = regexp_replace(s.path, '\\.[a-z]+$', '')
 WHERE NOT (d.lang = 'en') GROUP BY ALL
 UNION ALL SELECT path, 'rescanned', 1 FROM files JOIN documents d ON d.doc_id = file_ord WHERE d.lang = 'en' AND contains(code, '(')""")
def _j10(spark, sf):
    files = corpus(spark, sf)
    english = table(spark, sf, "documents").where("lang = 'en'").select(F.col("doc_id").alias("file_ord"))
    again = files.join(english, "file_ord", "left_semi")
    fresh = again.where(F.contains("code", F.lit("("))).select("batch_id", "file_ord", "path", F.lit("rescanned").alias("type"))
    new = fixes.refresh(detect.detect(files, R.security_rules()), again, fresh)
    return new.groupBy("path", "type").agg(F.count("*").alias("n"))


@query("S3_rulepack_of_sector", "SELECT * FROM (VALUES " + ", ".join(
    f"('{pack}', '{rid}', '{kind}', '{sev}', {_sql(p)}, {n})" for pack, rid, kind, sev, _m, ps in fv.SECTOR_RULES for p in ps
    for n in [0]) + ") AS r(pack, rule_id, type, severity, pattern, zero) JOIN (SELECT source, ['finance','healthcare','telecom','public_sector','government'][CAST(replace(source,'src','') AS INTEGER) % 5 + 1] AS pack, count(*) AS n_files FROM documents GROUP BY ALL) USING (pack)")
def _s3(spark, sf):
    from checks.logs import scratch
    from codesieve.rules import rules_frame, sector_rules
    from codesieve.sources import readers

    packs, folder = ["finance", "healthcare", "telecom", "public_sector", "government"], scratch(spark) + "/packs"
    names = F.array(*[F.lit(x) for x in packs])
    wanted = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n_files")).withColumn(
        "pack", F.element_at(names, F.regexp_replace("source", "src", "").cast("int") % 5 + 1))
    rules_frame(spark, sector_rules()).write.partitionBy("pack").parquet(folder)
    stored = [readers.read_rulepacks(spark, folder, pack).select("pack", "rule_id", "type", "severity", "pattern", F.lit(0).alias("zero")) for pack in packs]
    rules = stored[0].unionByName(stored[1]).unionByName(stored[2]).unionByName(stored[3]).unionByName(stored[4])
    return wanted.join(F.broadcast(rules), "pack")


@query("P8_sector_per_batch", f"""WITH {CORPUS}, {_OPT}, s AS (SELECT batch_id, coalesce(
   CASE n % 3 WHEN 0 THEN 'telecom' END, CASE n % 2 WHEN 0 THEN 'public_sector' END, 'finance') AS sector FROM opt)
 SELECT path, sector, pattern FROM (""" + " UNION ALL ".join(
    f"SELECT path, sector, {_sql(p)} AS pattern FROM files JOIN s USING (batch_id) WHERE sector = '{pack}' AND regexp_matches(code, {_sql(p)})"
    for pack, _r, _k, _s, _m, ps in fv.SECTOR_RULES for p in ps) + ")")
def _p8(spark, sf):
    n = F.regexp_replace("batch_id", "src", "").cast("int")
    request = F.when(n % 3 == 0, "telecom").otherwise("")
    configured = F.when(n % 2 == 0, "public_sector")
    files = corpus(spark, sf).withColumn("sector", options.resolve_sector(request, configured))
    found = detect.sector(files)
    names = files.select("batch_id", "sector").distinct()
    return found.join(names, "batch_id").select("path", "sector", "pattern")


@query("P10_P11_language_toggles", f"""WITH {CORPUS} SELECT path, 'logging_practice' AS type FROM (
  {spans(fv.LOGGING_GENERIC, '', 0, LANG['generic'])}) UNION ALL SELECT path, 'error_handling' FROM ({spans(fv.IGNORED_ERROR_GO, '', 0, LANG['go'])} UNION ALL {spans(fv.PANIC_GO, '', 0, LANG['go'])})""")
def _p10(spark, sf):
    files = corpus(spark, sf)
    on = "named_struct('naming', {}, 'logging', {}, 'error_handling', {}, 'typing', {})"
    none = "cast(null as boolean)"
    per_language = F.expr(
        "map('python', " + on.format("false", "true", "false", none) + ", 'go', " + on.format(none, "false", none, none)
        + ", 'default', " + on.format("false", none, "false", none) + ", 'javascript', " + on.format("false", "false", "false", "false")
        + ", 'typescript', " + on.format("false", "false", "false", "false") + ", 'java', " + on.format("false", "false", "false", "false") + ")")
    from codesieve.functions import text

    language = text.guess_language(F.col("path"))
    flat = F.expr(on.format(none, none, none, "true"))
    chosen = files.withColumn("toggles", options.resolve_toggles(flat, per_language, language))
    return detect.detect(chosen, R.coding_rules()).select("path", "type")
