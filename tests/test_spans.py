"""Native spans against ``re.finditer`` for every built-in pattern and for texts with many matches."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve import rules as R
from codesieve.functions import regex, text
from codesieve.operators import detect

PIECES = [
    "AKIA", "ABCDEFGHIJKLMNOP", "password", " = ", "'abcdefgh'", '"', "execute(", "SELECT a FROM t ", "+", ")", "\n", "\r\n", " ", "eval(",
    "os.system(", "open(", "request", "md5(", "SHA1(", "generated by copilot", "def ", "Bad_Name", "(", "function get_it(", "const a_b = (",
    "print(", "console.log(", "fmt.Println(", "except", " :", " Exception:", "catch (e) { }", "catch (Exception e)", "_ = go(", "panic(", "any",
    "SPDX-License-Identifier: ", "GPL-3.0", "MIT License", "mit licenſe", "ü", " ", "\x1c", "\x85", " ", "é_a(", "path.join(", "Path(input).unlink()",
    "\x01", "\x02", "\x01\x02\x03\x04", "$0", "\\", "INSERT INTO t ", "UPDATE ", " SET", "sk-abcdefghijklmnopqrstuvwxyz", "xoxb-1234567890", "日本", "😀", "System.out.println(", "API-KEY: ", "{", "}",
]


def random_texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_all_builtin_patterns(spark, seed):
    rules = R.builtin_rules()
    texts = random_texts(150, seed)
    rows = [("b", i, f"{i}.{ext}", t) for i, (t, ext) in enumerate(zip(texts, ["py", "ts", "java", "go", "js"] * 30))]
    files = spark.createDataFrame(rows, "batch_id string, file_ord bigint, path string, code string")
    got = {(r.file_ord, r.rule_ix, r.m, r.g, r.start, r.end, r.line) for r in detect.rule_hits(files, rules).collect()}
    group_of = {"py": "generic", "ts": "js", "js": "js", "java": "java", "go": "go"}
    want = set()
    for _, i, path, code in rows:
        ext = path.split(".")[1]
        for ix, r in enumerate(rules):
            if r["lang_group"] and r["lang_group"] != group_of[ext] or r["language"] and ext != "ts":
                continue
            g = r["match_group"]
            for m in re.finditer(r["pattern"], code, re.I if r["ignore_case"] else 0):
                want.add((i, ix, m.group(0), m.group(g), m.start(g), m.end(g), code.count("\n", 0, m.start(g)) + 1))
    assert len(want) > 300

    def shown(rows):  # license findings carry no offsets
        return {x[:4] if rules[x[1]]["family"] == "license_ip" else x for x in rows}

    assert shown(got) == shown(want)


def test_gates_never_hide_a_match(spark):
    """The gate of a pattern holds for every text that matches it."""
    texts = random_texts(300, 7)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, code string").withColumn("hay", F.lower("code")).withColumn(
        "odd", F.contains("code", F.lit(regex.ODD_FOLDS[0])) | F.contains("code", F.lit(regex.ODD_FOLDS[1])) | F.contains("code", F.lit(regex.ODD_FOLDS[2])))
    rules = R.builtin_rules() + R.sector_rules()
    out = df.select("id", *[F.expr(regex.gate_sql(r["pattern"], bool(r["ignore_case"]))[0]).alias(f"g{k}") for k, r in enumerate(rules)]).collect()
    for row in out:
        for k, r in enumerate(rules):
            if re.search(r["pattern"], texts[row.id], re.I if r["ignore_case"] else 0):
                assert row[f"g{k}"], (r["pattern"], texts[row.id])


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 256, 1000])
def test_many_matches(spark, n):
    code = "é\n".join(["any"] * n) + " x"
    files = spark.createDataFrame([("b", 0, "a.ts", code)], "batch_id string, file_ord bigint, path string, code string")
    got = sorted((r.start, r.end, r.line) for r in detect.rule_hits(files, [r for r in R.coding_rules() if r["toggle"] == "typing"]).collect())
    want = [(m.start(), m.end(), code.count("\n", 0, m.start()) + 1) for m in re.finditer(fv.ANY_TYPE_TS, code)]
    assert got == want


@pytest.mark.parametrize("pattern", ["x*", "(?=a)", "^", "a|", r"\b", "(?i)B*"])
def test_patterns_that_match_empty(spark, pattern):
    texts = ["", "aaxb\nxx b", "é x\n"]
    files = spark.createDataFrame([("b", i, f"{i}.py", t) for i, t in enumerate(texts)], "batch_id string, file_ord bigint, path string, code string")
    assert regex.may_match_empty(pattern)
    got = sorted((r.file_ord, r.start, r.end) for r in detect.detect(files, R.custom_rules([{"pattern": pattern}])).collect())
    want = sorted((i, m.start(), m.end()) for i, t in enumerate(texts) for m in re.finditer(pattern, t, re.M))
    assert got == want


def test_restricted_names_are_literals(files):
    found = detect.restricted(files("uses a+b licence", "aab", "A+B"), ["a+b"]).collect()
    assert sorted(r.path for r in found) == ["f0.py", "f2.py"]


def test_line_and_strip_functions(spark):
    texts = ["", "a", "a\n", "a\r\nb\r", "\n\n", "  x \x1f", "a\x0bb\x0cc\x1cd\x1ee\x85f g ", "\ta b \n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string")
    out = df.select("id", text.split_lines(F.col("t")).alias("l"), text.strip(F.col("t")).alias("s"), text.rstrip(F.col("t")).alias("r")).collect()
    for r in out:
        assert r.l == texts[r.id].splitlines(), repr(texts[r.id])
        assert (r.s, r.r) == (texts[r.id].strip(), texts[r.id].rstrip())


def test_extension_like_splitext(spark):
    import os

    paths = ["a.py", "a/b.tar.GZ", ".bashrc", "..x", "a/.env.js", "dir.d/file", "x.", "a", "a/..b.c", "", "q/w.e/r.T"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for r in df.select("p", text.extension(F.col("p")).alias("e")).collect():
        assert r.e == os.path.splitext(r.p)[1].lower(), r.p


def test_required_literals():
    assert regex.required_literals(r"a(b|bc|)d")[1] is False
    assert regex.required_literals("patient_name|ssn") == ([["patient_name", "ssn"]], True)
    assert regex.required_literals("foo(bar|baz)qux")[0][0]
    for pattern in ("x?", "[ab]", ".*", "(a|)b?"):
        gate, sufficient = regex.gate_sql(pattern)
        assert not sufficient or gate != "true"
