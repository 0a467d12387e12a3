"""Translated patterns against ``re.finditer``, with flags, groups and the forms that stay in Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from codesieve import rules as R
from codesieve.functions import pattern, regex
from codesieve.operators import detect, repository

# (pattern, flags, group)
TABLE = [
    (r"(?P<q>['\"])x+(?P=q)", 0, 0), ("a{,2}b", 0, 0), ("(?#c)ab", 0, 0), ("(?im)^x$", 0, 0), (r"(?s)a.b", 0, 0), (r"(?x) a b  # c", 0, 0), (r"^a|b$", 0, 0),
    (r"^a|b$", re.M, 0), (r"\Aab", re.M, 0), (r"b\Z", re.M, 0), (r"x$", 0, 0), (r"\bab\b", 0, 0), (r"\Bb", 0, 0), (r"a\b.", 0, 0), (r".\b.", 0, 0), (r"\w+", 0, 0), (r"\W+", 0, 0),
    (r"\d+", 0, 0), (r"\D+", 0, 0), (r"\s+", 0, 0), (r"\S+", 0, 0), (r"[\w.]+", 0, 0), (r"[^\w]+", 0, 0), (r"[^\W\d]+", 0, 0), (r"[\W\d]+", 0, 0), (r"[^\s\S]x|a", 0, 0),
    (r"(?a)\w+", 0, 0), (r"(?a)\d\s\w", 0, 0), (r"(?a:\w)\w", 0, 0), (r"(?i:a)b", 0, 0), (r"(?i)a(?-i:b)", 0, 0), (r"(?ai)k+", 0, 0), (r"k+|s+", re.I, 0), (r"[a-k]+", re.I, 0),
    (r"é+", re.I, 0), (r"[]a]+", 0, 0), (r"[^]a]+", 0, 0), (r"[a&&b]+", 0, 0), (r"[\[x]+", 0, 0), (r"a-b_c", 0, 0), (r"#x|~", 0, 0), (r"\.\*\+", 0, 0), (r"\x41|\u00e9|\101", 0, 0),
    (r"(?<=a)b", 0, 0), (r"(?<!a)b", 0, 0), (r"a(?=b)", 0, 0), (r"a(?!b)", 0, 0), (r"(?>a+)b", 0, 0), (r"a++b", 0, 0), (r"a+?b", 0, 0), (r"(?:ab){2}", 0, 0), (r"(?:ab)+", 0, 0),
    (r"(a|b)\1", 0, 0), (r"(?i)(a)\1", 0, 0), (r"(ab)c?\1", 0, 0), (r"(a)(b)(x)?1?", 0, 0), ("😀+", 0, 0), ("[😀-😂]x", 0, 0), (r"[^😀a]+", 0, 0), ("\n+", 0, 0), (r"a\tb|\x00", 0, 0),
    # a group whose text also occurs before it
    (r"a+(a)", 0, 1), (r"(\w+) (\w+)", 0, 2), (r"x(a)x?(a)", 0, 2), (r"(?:a(b)a)b", 0, 1), (r"((a)b)a", 0, 2), (r"((a)b)(a)", 0, 3), (r"b(?=a)(a)(?=b)", 0, 1), (r"(a)\1(a)", 0, 2),
    (r"\b(a+)\s*b", 0, 1), (r"(?i)X(x)", 0, 1), (r"(?<=b)(a)(b*)", 0, 2), (r"(?P<k>\w)=(?P<v>\w)", 0, 2), (r"(?>b(a))", 0, 1), (r"(a|b)(é|😀)", 0, 2), (r"(\n)(a)", 0, 2), (r"^(.)(a)", re.M, 2),
]
PYTHON_ONLY = [(r"(a)?b(?(1)a|x)", 0), (r"(?:\w+\s)+x", 0), (r"(?:a|bb)*x", 0), (r"a*", 0), (r"(a)|b", 1), (r"(?:(a)b)+", 1), (r"(a?)*x", 0), (r"(a)(?<=\1)b", 0), (r"(?ai)(k)\1", 0)]
PIECES = ["a", "b", "ab", "x", "X", "A", "aa", "'", '"', " ", "\n", "\r", "\t", "1", "٣", "é", "É", "ſ", "K", "k", "s", "İ", "ı", "_", ".", "-", "#", "~", "&", "]", "[", "^", "*", "+", "😀", "😁", "́",
          "\x1c", "\x85", " ", "中", "²", "\x00", "=", "\x01", "\x02", "\x03", "\x04", "$1", "\\"]


def texts_of(seed, n=120):
    rng = random.Random(seed)
    return ["", "a\n", "\n"] + ["".join(rng.choice(PIECES) for _ in range(rng.randrange(30))) for _ in range(n)] + ["".join(PIECES) * 2]


def test_table_of_patterns(spark):
    texts = texts_of(1)
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, code string").repartition(1).withColumn("mark", F.expr(regex.mark_sql("code")))
    assert rows.where("mark is null").count()
    how = []
    for k, (p, flags, group) in enumerate(TABLE):
        t = pattern.translate(p, flags, group)
        assert pattern.python_reason(p, flags, group) is None, p
        how.append((k, t.java, t.own, list(t.before), list(t.after)))
    forms = spark.createDataFrame(how, "k int, java string, own int, before array<int>, after array<int>")
    found = rows.join(F.broadcast(forms)).select("id", "k", F.expr(regex.spans_sql("code", "java", "own", "before", "after")).alias("h")).select("id", "k", F.inline("h"))
    got = {(r.k, r.id, r.m, r.g, r.start, r.end, r.line) for r in found.collect()}
    want = {(k, i, m.group(), m.group(g), m.start(g), m.end(g), t.count("\n", 0, m.start(g)) + 1)
            for k, (p, flags, g) in enumerate(TABLE) for i, t in enumerate(texts) for m in re.compile(p, flags).finditer(t)}
    wrong = {TABLE[x[0]] for x in got ^ want}
    assert not wrong, sorted(got ^ want)[:5]
    assert len({x[0] for x in want}) >= len(TABLE) - 8


def test_whole_match_without_group_columns(spark):
    rows = spark.createDataFrame(list(enumerate(texts_of(2))), "id int, code string").withColumn("mark", F.expr(regex.mark_sql("code")))
    p = regex.java_pattern(r"(a+)(b|x)")
    got = {(r.id, r.m, r.start) for r in rows.select("id", F.expr(f"inline({regex.spans_sql('code', regex.sql_str(p))})")).collect()}
    assert got == {(i, m.group(), m.start()) for i, t in enumerate(texts_of(2)) for m in re.finditer(r"(a+)(b|x)", t)}


@pytest.mark.parametrize("p, group", PYTHON_ONLY)
def test_forms_that_stay_in_python(spark, p, group):
    assert pattern.python_reason(p, 0, group)
    texts = texts_of(3)
    files = spark.createDataFrame([("b", i, f"{i}.py", t) for i, t in enumerate(texts)], "batch_id string, file_ord bigint, path string, code string")
    rule = R.custom_rules([{"pattern": p}])[0] | {"match_group": group}
    got = sorted((r.file_ord, r.start, r.end) for r in detect.detect(files, [rule]).collect())
    assert got == sorted((i, m.start(group), m.end(group)) for i, t in enumerate(texts) for m in re.finditer(p, t, re.M))
    once = detect.detect(files, [rule | {"exists_only": True}]).count()
    assert once == sum(re.search(p, t, re.M) is not None for t in texts)


def test_python_rows_are_linear():
    code = "ab\n" * 200_000
    rows = detect.twin_rows(re.compile("a"), 0, False, code)
    assert len(rows) == 200_000 and rows[-1] == ("a", None, 599_997, 599_998, 200_000) or rows[-1][2:] == (599_997, 599_998, 200_000)


def test_rule_plan_names_the_reason(spark):
    rules = spark.createDataFrame([("r", "(a)?b(?(1)a|x)"), ("r", "abc"), (None, "(unclosed"), (None, "(?:a|bb)*x"), ("r", None), ("r", "")], "repo string, pattern string")
    got = {r.pattern: (r.repo, r["mode"], r.reason is not None) for r in repository.rule_plan(rules).collect()}
    assert got == {"(a)?b(?(1)a|x)": ("r", "twin", True), "abc": ("r", "spans", False), "(unclosed": (None, "invalid", True), "(?:a|bb)*x": (None, "twin", True)}
