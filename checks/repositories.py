"""Rules of repositories, translated patterns and scans that configuration drives."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from checks.corpus import CORPUS, DOCS, _sql, corpus, docs, table
from checks.detection import spans
from checks.logs import scratch
from checks.registry import query
from codesieve import fixed_values as fv
from codesieve.functions import pattern, regex
from codesieve.operators import detect, repository
from codesieve.plans import configured
from codesieve.sources import readers

# --- J1, D22: a rule for each longer word of the benchmark, for one source or for all -------
_WORDS = "SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{7,}')) AS w FROM benchmark"


@query("J1_D22_rules_of_repositories", f"""WITH {DOCS}, words AS ({_WORDS}),
 rules AS (SELECT w, w || '[a-z]*' AS p, CASE WHEN length(w) >= 12 THEN NULL ELSE 'src' || (unicode(w) + 7 * length(w)) % 20 END AS repo FROM words),
 hits AS (SELECT path, w, regexp_extract_all(code, p) AS m, regexp_split_to_array(code, p) AS s FROM files JOIN rules ON (repo IS NULL OR repo = batch_id) AND contains(code, w)),
 each AS (SELECT path, w, m, s, unnest(range(1, len(m) + 1)) AS k FROM hits)
 SELECT path, w AS rule_id, start, CAST(start + len AS INTEGER) AS stop FROM (SELECT path, w, length(m[k]) AS len,
  CAST(list_sum(list_transform(s[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS INTEGER) AS start FROM each)""")
def _rules_of_repositories(spark, sf):
    """Rules from a table, each for one repository or for all, in one scan of all documents."""
    words = table(spark, sf, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{7,})"))).alias("w")).distinct()
    place = (F.ascii("w") + 7 * F.length("w")) % 20
    rules = words.select(F.when(F.length("w") < 12, F.concat(F.lit("src"), place)).alias("repo"), F.col("w").alias("rule_id"), F.concat("w", F.lit("[a-z]*")).alias("pattern"))
    files = docs(spark, sf).withColumn("repo", F.col("batch_id"))
    return repository.detect_table(files, rules).select("path", "rule_id", "start", F.col("end").alias("stop"))


# --- F1, F2: group positions, and syntax that only Python has --------------------------------


@query("F1_group_positions", f"""WITH {DOCS}, m AS ({spans('([a-z]*)(th)(e|a)')})
 SELECT path, match, CAST(start + length(regexp_extract(match, '^([a-z]*)(th)(e|a)$', 1)) AS INTEGER) AS start FROM m""")
def _group_positions(spark, sf):
    """Place of a group whose text may also stand before it in the match."""
    t = pattern.translate("([a-z]*)(th)(e|a)", group=2)

    def numbers(groups):
        return f"array({', '.join(map(str, groups))})"

    found = regex.spans_sql("code", regex.sql_str(t.java), str(t.own), numbers(t.before), numbers(t.after), mark=f"({regex.mark_sql('code')})")
    return docs(spark, sf).select("path", F.explode(F.expr(found)).alias("h")).select("path", F.col("h.m").alias("match"), F.col("h.start").alias("start"))


# (Python's pattern, what the oracle's engine takes in its place)
SYNTAX = [
    (r"(?im)^(?P<first>an|th)(?#c)[a-z]{,2}\s", r"(?im)^(an|th)[a-z]{0,2}\s"),
    (r"(?P<q>['\"])[a-z ]+(?P=q)", r"""'[a-z ]+'|"[a-z ]+\""""),
    (r"(?x) ( [a-z]+ ) \s [0-9]{3,}  # a number", r"[a-z]+\s[0-9]{3,}"),
    (r"(an)?d(?(1)e|i)", r"ande|di"),
]


@query("F2_D22_python_syntax", f"WITH {CORPUS} " + " UNION ALL ".join(
    f"SELECT path, {k + 1} AS rule_ord, CAST(len(regexp_extract_all(code, {_sql(p)})) AS BIGINT) AS matches FROM files WHERE regexp_matches(code, {_sql(p)})" for k, (_, p) in enumerate(SYNTAX[:3]))
    + f""" UNION ALL SELECT path, 4, CAST(len(regexp_extract_all(code, 'ande|d(?:i)')) AS BIGINT) FROM files WHERE regexp_matches(code, '{SYNTAX[3][1]}')""")
def _python_syntax(spark, sf):
    """Patterns with Python's own syntax; the last one has no Java form and runs in Python."""
    rules = [{"pattern": p} for p, _ in SYNTAX]
    from codesieve.rules import custom_rules

    found = detect.detect(corpus(spark, sf), custom_rules(rules))
    return found.groupBy("path", "rule_ord").agg(F.count("*").alias("matches"))


# --- S4, L7, D22, X1: configuration drives a scan --------------------------------------------
# sources 0, 3, ...: rules, names, sector and policy of their own; 1, 4, ...: one toggle; 2, 5, ...: the organisation's only
_ORG = {"coding_standards": [{"id": "O-1", "pattern": r"TODO|print\("}], "policy": {"house": "warning", "logging_practice": "warning"},
        "coding_standards_builtin": {"default": {"naming": False}}}
_RULES = {"coding_standards": [{"id": "A-1", "pattern": ["^except", r"(?P<q>['\"])[a-z]+(?P=q)"], "type": "house", "severity": "blocking"}], "restricted_licenses": ["Mit"],
          "policy": {"house": "blocking"}, "sector": "telecom"}
_TOGGLE = {"coding_standards_builtin": {"default": {"logging": False}}}
_QUOTED = "'[a-z]+'|\"[a-z]+\""
_NAMES = " UNION ALL ".join(f"SELECT path, 'restricted_license' AS type, {_sql(n)} AS rule, -1 AS start, 'advisory' AS policy_level FROM files WHERE "
                            f"{'NOT ' if n != 'Mit' else ''}(n % 3 = 0) AND contains(lower(code), {_sql(n.lower())})" for n in [*fv.RESTRICTED_LICENSES, "Mit"])
_SECTORS = " UNION ALL ".join(
    f"SELECT path, {_sql(kind)} AS type, {_sql(rule_id)} AS rule, -1 AS start, '{'warning' if kind == 'logging_practice' else 'advisory'}' AS policy_level FROM files WHERE (n % 3 = 0) = {pack == 'telecom'} AND regexp_matches(code, {_sql(p)})"
    for pack, rule_id, kind, _, _, patterns in fv.SECTOR_RULES if pack in ("telecom", fv.DEFAULT_SECTOR) for p in patterns)


@query("S4_L7_D22_configured_scan", f"""WITH {CORPUS.replace('files AS (', 'base AS (')}, files AS (SELECT *, CAST(replace(batch_id, 'src', '') AS INTEGER) AS n FROM base)
 SELECT path, 'coding_standard' AS type, 'O-1' AS rule, start, 'advisory' AS policy_level FROM ({spans(r'TODO|print\(', where='n % 3 > 0')})
 UNION ALL SELECT path, 'house', 'A-1', start, 'blocking' FROM ({spans('(?m)^except', where='n % 3 = 0')})
 UNION ALL SELECT path, 'house', 'A-1', start, 'blocking' FROM ({spans(_QUOTED, where='n % 3 = 0')})
 UNION ALL SELECT path, 'logging_practice', NULL, start, 'warning' FROM ({spans(fv.LOGGING_GENERIC, where="n % 3 <> 1 AND ext NOT IN ('.js', '.ts', '.java', '.go')")})
 UNION ALL SELECT path, 'logging_practice', NULL, start, 'warning' FROM ({spans(fv.LOGGING_JS, where="n % 3 <> 1 AND ext IN ('.js', '.ts')")})
 UNION ALL SELECT path, 'logging_practice', NULL, start, 'warning' FROM ({spans(fv.LOGGING_JAVA, where="n % 3 <> 1 AND ext = '.java'")})
 UNION ALL SELECT path, 'logging_practice', NULL, start, 'warning' FROM ({spans(fv.LOGGING_GO, where="n % 3 <> 1 AND ext = '.go'")})
 UNION ALL {_NAMES} UNION ALL {_SECTORS}""")
def _configured_scan(spark, sf):
    """One scan over repositories with configurations of their own, read from files; the detectors that these change."""
    files, folder = corpus(spark, sf), scratch(spark) + "/config"
    batches = files.select("batch_id").distinct().withColumn("repo", F.col("batch_id"))
    n = F.regexp_replace("repo", "src", "").cast("int")
    own = batches.where(n % 3 < 2).select(F.lit("repo").alias("scope"), "repo", F.lit(fv.CONFIG_PATHS[0]).alias("config_path"),
                                          F.when(n % 3 == 0, json.dumps(_RULES)).otherwise(json.dumps(_TOGGLE)).alias("body"))
    org = spark.range(1).select(F.lit("org").alias("scope"), F.lit(None).cast("string").alias("repo"), F.lit(None).cast("string").alias("config_path"), F.lit(json.dumps(_ORG)).alias("body"))
    own.unionByName(org).write.json(folder)
    findings, _, _ = configured.configured_scan(files, batches, readers.read_config(spark, folder), unique_paths=True)
    changed = findings.where("detector in ('custom', 'sector') or type in ('restricted_license', 'naming_convention', 'logging_practice')")
    return changed.select("path", "type", F.coalesce("rule_id", "license").alias("rule"), F.coalesce("start", F.lit(-1)).alias("start"), "policy_level")
