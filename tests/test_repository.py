"""Rule tables of repositories against ``re``, and scans that configuration drives."""

import json
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve import rules as R
from codesieve.operators import detect, repository
from codesieve.plans import configured
from codesieve.sources import readers

FILES = "batch_id string, file_ord bigint, path string, code string, repo string"


def files_of(spark, n=60, seed=1):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta(", "x = 1", "licenſe", "GPL", "gpl", "\n", "'q'", "é", "İ", "  ", "except:", "TODO"]
    rows = [("b", i, f"f{i}.{rng.choice(['py', 'ts'])}", " ".join(rng.choice(words) for _ in range(rng.randrange(25))), rng.choice(["one", "two", None])) for i in range(n)]
    return rows + [("b", n, "null.py", None, "one"), ("b", n + 1, "empty.py", "", "two")]


def test_rules_of_two_repositories(spark):
    rows = files_of(spark)
    files = spark.createDataFrame(rows, FILES)
    table = [("one", "alpha|gamma", False), ("one", r"(?i)beta\s+(\w+)", False), ("two", r"^except", True), (None, r"TODO", False), ("two", r"(?P<q>')q(?P=q)", False),
             ("two", r"(?:a|é)+\s*x", False), ("one", "(broken", False), ("two", "license", False), (None, r"\bx\b", False), ("one", "x*", False)]
    rules = spark.createDataFrame([(r, p, m, k) for k, (r, p, m) in enumerate(table)], "repo string, pattern string, multiline boolean, rule_ord int")
    got = sorted((r.file_ord, r.rule_ord, r.start, r.end) for r in repository.detect_table(files, rules).collect())
    want = []
    for _, i, _, code, repo in rows:
        for k, (own, p, m) in enumerate(table):
            if p != "(broken" and (own is None or own == repo):
                want += [(i, k, x.start(), x.end()) for x in re.finditer(p, code or "", re.M if m else 0)]
    assert len(want) > 100 and got == sorted(x for x in want if rows[x[0]][3] is not None)


@pytest.mark.parametrize("limit", [4 << 20, 2000])
def test_built_in_rules_by_automaton(spark, monkeypatch, limit):
    """The automaton finds what the plan of expressions finds, in one part or many."""
    from tests.test_spans import random_texts

    monkeypatch.setattr(repository, "TABLE_BYTES", limit)
    rows = [("b", i, f"{i}.{e}", t, True if i % 3 else None, "finance" if i % 2 else "telecom") for i, (t, e) in enumerate(zip(random_texts(80, 5), ["py", "ts", "java", "go", "js"] * 16))]
    files = spark.createDataFrame(rows, "batch_id string, file_ord bigint, path string, code string, ai_generated boolean, sector string")
    files = files.withColumn("toggles", F.struct((F.col("file_ord") % 4 > 0).alias("naming"), F.lit(None).cast("boolean").alias("logging"), F.lit(True).alias("error_handling"), F.lit(True).alias("typing")))
    rules = R.builtin_rules() + R.sector_rules() + R.restricted_rules(["GPL", "licenſe", "mit license"])
    want = sorted(map(repr, detect.detect(files, rules, flag_generated=True).collect()))
    got = sorted(map(repr, repository.detect_table(files, R.rules_frame(spark, rules), flag_generated=True).collect()))
    assert len(want) > 200 and got == want


def test_five_thousand_rules_plan_quickly(spark):
    rules = spark.range(5000).select(F.concat(F.lit("repo"), F.col("id") % 50).alias("repo"), F.concat(F.lit("word"), "id", F.lit(r"\s*\(")).alias("pattern"), F.col("id").cast("int").alias("rule_ord"))
    files = spark.createDataFrame([("b", i, f"{i}.py", f"word{i} (word{i + 50} (word{i + 1}(", f"repo{i % 50}") for i in range(200)], FILES)
    began = time.time()
    found = detect.detect(files, rules)
    found._jdf.queryExecution().executedPlan()
    assert time.time() - began < 10
    assert sorted((r.file_ord, r.rule_ord) for r in found.collect()) == sorted((i, i + k) for i in range(200) for k in (0, 50))


def test_tables_without_rows(spark):
    files = spark.createDataFrame(files_of(spark), FILES)
    none = spark.createDataFrame([], "repo string, pattern string")
    assert repository.detect_table(files, none).count() == 0
    assert repository.detect_table(files.where("false"), spark.createDataFrame([("one", "a")], "repo string, pattern string")).count() == 0


CONFIGS = {
    ("org", None): {"sector": "telecom", "coding_standards": [{"id": "O-1", "pattern": "orgword"}], "policy": {"house": "warning", "custom_x": "blocking"}, "ip_min_lines": 2, "ip_min_chars": 5,
                    "coding_standards_builtin": {"python": {"logging": False}, "default": {"naming": False}}},
    ("repo", "one"): {"coding_standards": [{"id": "C-1", "pattern": ["^one", "(?P<q>['\"])k(?P=q)"], "type": "house", "severity": "blocking"}, {"pattern": ""}, {"pattern": "[ab]c", "type": "custom_x"}],
                      "restricted_licenses": ["Foo"], "policy": {"house": "blocking"}, "ip_min_lines": 0, "ip_min_chars": 0, "sector": "finance"},
    ("repo", "two"): {"coding_standards_builtin": {"python": {"error_handling": False}, "default": {"typing": False}}, "copilot_strict": False},
}


def configs(spark):
    return spark.createDataFrame([(s, r, None if r is None else fv.CONFIG_PATHS[0], json.dumps(c)) for (s, r), c in CONFIGS.items()], "scope string, repo string, config_path string, body string")


def test_every_repository_has_a_configuration(spark):
    repos = spark.createDataFrame([("one",), ("two",), ("three",), ("one",)], "repo string")
    got = {r.repo: r.config for r in readers.effective_config(configs(spark), repos=repos).collect()}
    assert sorted(got) == ["one", "three", "two"]
    assert [got[r].sector for r in ("one", "two", "three")] == ["finance", "telecom", "telecom"]
    assert got["one"].policy == {"house": "blocking", "custom_x": "blocking"}
    merged = {k: json.loads(v) for k, v in got["two"].coding_standards_builtin.items()}
    assert {k: {n: str(b).lower() for n, b in v.items()} for k, v in merged.items()} == {"python": {"logging": "false", "error_handling": "false"}, "default": {"naming": "false", "typing": "false"}}
    assert sorted(r.repo for r in readers.effective_config(configs(spark)).collect()) == ["one", "two"]
    alone = readers.effective_config(configs(spark).where("scope = 'repo'"), repos=repos).where("repo = 'three'").first()
    assert alone.config.sector is None


def test_configuration_drives_a_scan(spark):
    code = "one 'k'\nxone \"k\" ac\norgword foo GPL\nprint('x')\ndef BadName():\n    pass\nexcept:\nl1 abc\nl2 abc\nl1 abc\nl2 abc\n"
    files = spark.createDataFrame([(b, i, f"p{i}.py", code + str(b) * 3) for b in ("x", "y", "z", "n") for i in range(2)], "batch_id string, file_ord bigint, path string, code string")
    batches = spark.createDataFrame([("x", "one", None, None), ("y", "two", "", None), ("z", "three", "finance", {"logging_practice": "blocking"}), ("n", None, None, None)],
                                    "batch_id string, repo string, sector string, policy map<string,string>")
    findings, per_file, per_batch = configured.configured_scan(files, batches, configs(spark), cross_file=True)
    rows = findings.where("file_ord = 0").collect()

    def of(batch, *types):
        return sorted(((r.type, r.rule_id, r.start, r.policy_level) for r in rows if r.batch_id == batch and (r.detector in types or r.type in types)), key=repr)

    house = [("house", "C-1", m.start(), "blocking") for p in ("^one", "(?P<q>['\"])k(?P=q)") for m in re.finditer(p, code, re.M)]
    assert len(house) == 3 and of("x", "custom") == sorted(house + [("custom_x", None, m.start(), "blocking") for m in re.finditer("[ab]c", code)], key=repr)
    at = code.index("orgword")
    for batch in ("y", "z", "n"):
        assert of(batch, "custom") == [("coding_standard", "O-1", at, "advisory")]
    restricted = {b: sorted(r.license for r in rows if r.batch_id == b and r.type == "restricted_license") for b in "xyzn"}
    assert restricted == {"x": ["Foo"], "y": ["GPL"], "z": ["GPL"], "n": ["GPL"]}
    assert {b: [t for t in ("logging_practice", "naming_convention", "error_handling") if of(b, t)] for b in "xyzn"} == {
        "x": ["naming_convention", "error_handling"], "y": ["naming_convention"], "z": ["naming_convention", "error_handling"], "n": ["naming_convention", "error_handling"]}
    blocks = {b: sum(r.type == "ip_near_duplicate" for r in rows if r.batch_id == b) for b in "xyzn"}
    assert blocks["x"] == 0 and blocks["y"] > 0 and blocks["y"] == blocks["z"] == blocks["n"]
    assert {r.batch_id: r.policy for r in per_batch.collect()}["x"] == "blocking" and per_file.count() == 8
    again = {r.scope for r in configured.configured_batches(batches, configs(spark)).collect()}
    assert len(again) == 2


def test_task_functions_can_be_shipped_by_value(spark):
    """Sessions that were started from another folder have no package on their workers' path."""
    from pyspark import cloudpickle

    import codesieve
    from codesieve.operators import duplicates, limiter
    from codesieve.sources import audit_log
    from codesieve.streaming import batches

    class Table:
        value = None

    parts = [repository._searched, repository._named(Table, 0, 1), repository._Lookup, detect.twin_rows, batches.Arrivals(1), limiter.Admissions(1, 1),
             audit_log._chained(audit_log.Head(0, 1, {}), b"k"), duplicates._chosen(Table, 5).func]
    cloudpickle.register_pickle_by_value(codesieve)
    try:
        sizes = [len(cloudpickle.dumps(p)) for p in parts]
    finally:
        cloudpickle.unregister_pickle_by_value(codesieve)
    assert min(sizes) > 500
