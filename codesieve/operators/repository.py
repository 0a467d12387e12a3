"""Rule tables of any size, with rules of single repositories: tokens by automaton, rules by join.

A rule table may name a repository in each row; rules without one hold for all.  Every rule is compiled in a
task (Java pattern, required literals).  The literals of all rules form one Aho-Corasick automaton, built once and
broadcast; a task runs it over the lower-cased text and looks up (repository, token) to get the few rules that can match.
Only those rows meet the rule rows and the regex engine, so neither plan nor work grows with the number of rules.
A table above ``TABLE_BYTES`` is split by hash into parts of that size, and each is one pass over the text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve import rules as R
from codesieve.functions import pattern, regex, text
from codesieve.operators import detect
from codesieve.operators.findings import union_findings

#: Bytes of patterns and messages of the rules that one pass holds; this bounds the automaton and the broadcast rule rows.
TABLE_BYTES = 4 << 20

_FORM = detect.HOW + ", reason string, fold boolean, gates array<array<string>>, tokens array<string>"
_RULE = "repo string, " + R.RULE_SCHEMA
_DEFAULTS = {"pack": "custom", "kind": "custom", "family": "coding", "detector": "custom", "detector_ord": 5, "rule_ord": 1, "pattern_ord": 1,
             "ignore_case": False, "multiline": False, "match_group": 0, "exists_only": False, "type": "coding_standard",
             "message": "Coding standard violation."}


def _searched(rule: dict) -> dict:
    """A rule's form, the literals its matches hold, and the tokens of which one occurs in every match (none: always tried)."""
    try:
        form = detect.compiled(rule)
    except (re.error, OverflowError, RecursionError) as e:
        return {"mode": "invalid", "reason": str(e), "fold": False, "gates": [], "tokens": []}
    fold = bool(rule["ignore_case"])
    if rule["kind"] == "restricted":
        literal = [rule["pattern"]] if rule["pattern"].isascii() else []
        return form | {"mode": "exists", "java": "(?iu)" + re.escape(rule["pattern"]), "fold": True,
                       "gates": [literal] if literal else [], "tokens": [x.lower() for x in literal]}
    tree = pattern.parsed(rule["pattern"])
    fold |= bool(tree.state.flags & re.I)
    gates = [] if pattern.has_scoped_flags(tree) else regex.required_literals(rule["pattern"])[0]
    if fold:
        gates = [g for g in gates if all(lit.isascii() for lit in g)]
    tokens = regex.token_literals(rule["pattern"]) or []
    return form | {"fold": fold, "gates": gates, "tokens": [t.lower() for t in tokens]}


def _whole(rules: DataFrame) -> DataFrame:
    """All columns of a rule; missing ones and null values take the defaults of user rules, rows without a pattern are left out."""
    columns = []
    for part in _RULE.split(", "):
        name, kind = part.split()
        value = F.col(name).cast(kind) if name in rules.columns else F.lit("warning" if name == "severity" else None).cast(kind)
        columns.append((F.coalesce(value, F.lit(_DEFAULTS[name]).cast(kind)) if name in _DEFAULTS else value).alias(name))
    own = rules.select(*columns).where("pattern <> ''")
    if "multiline" not in rules.columns:
        return own.withColumn("multiline", F.col("kind") == "custom")  # user rules match line by line
    return own


def compiled_table(rules: DataFrame) -> DataFrame:
    """Rules with their form: columns of the rule, ``mode`` (``invalid`` for patterns Python rejects), ``java``, ``reason``, gates and tokens."""
    names = [part.split()[0] for part in _FORM.replace("array<array<string>>", "x").split(", ")]

    def compile_rows(batches):
        for pdf in batches:
            found = [_searched(r) for r in pdf.astype(object).where(pdf.notna(), None).to_dict("records")]
            yield pdf.assign(**{n: pd.Series([f.get(n) for f in found], dtype=object, index=pdf.index) for n in names})

    return _whole(rules).mapInPandas(compile_rows, f"{_RULE}, {_FORM}")


class _Lookup:
    """What a task needs to name a file's candidate rules: the automaton and the rules of each (repository, token)."""

    def __init__(self, rows: list):
        import ahocorasick

        self.rules = [(r.fold, [(list(g), [x.lower() for x in g]) for g in r.gates or []]) for r in rows]
        self.by_token: list[dict[str | None, list[int]]] = []
        self.always: dict[str | None, list[int]] = defaultdict(list)
        self.scopes = {r.repo for r in rows}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        places: dict[str, int] = {}
        for ix, r in enumerate(rows):
            if r.mode == "invalid":
                continue
            if not r.tokens:
                self.always[r.repo].append(ix)
            for token in dict.fromkeys(r.tokens or []):
                if token not in places:
                    places[token] = len(places)
                    self.by_token.append({})
                    self.automaton.add_word(token, places[token])
                self.by_token[places[token]].setdefault(r.repo, []).append(ix)
        self.always = dict(self.always)
        if places:
            self.automaton.make_automaton()

    @classmethod
    def of(cls, parts: dict) -> _Lookup:
        """From its parts: a broadcast names the classes in it, which workers may not have on their path."""
        own = cls.__new__(cls)
        own.__dict__.update(parts)
        return own

    def candidates(self, repo: str | None, code: str | None) -> list[int]:
        """Rules of the repository, or of all, whose literals occur in the text."""
        scopes = [s for s in ((None, repo) if repo is not None else (None,)) if s in self.scopes]
        if code is None or not scopes:
            return []
        hay = code.lower()
        odd = any(c in code for c in regex.ODD_FOLDS)
        found = {ix for s in scopes for ix in self.always.get(s, ())}
        tokens = range(len(self.by_token)) if odd else {t for _, t in self.automaton.iter(hay)} if self.by_token else ()
        for t in tokens:
            for s in scopes:
                found.update(self.by_token[t].get(s, ()))
        return sorted(ix for ix in found if self._open(ix, code, hay, odd))

    def _open(self, ix: int, code: str, hay: str, odd: bool) -> bool:
        fold, gates = self.rules[ix]
        if fold and odd:
            return True
        return all(any(x in hay for x in low) if fold else any(x in code for x in exact) for exact, low in gates)


def _named(lookup, code_at: int, repo_at: int):
    def step(batches):
        own = _Lookup.of(lookup.value)
        for batch in batches:
            wanted = [own.candidates(r, c) for r, c in zip(batch.column(repo_at).to_pylist(), batch.column(code_at).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(wanted, pa.list_(pa.int32()))], names=[*batch.schema.names, "wanted"])

    return step


def _applies(columns: list[str]) -> Column:
    """Language group, language, toggle and sector conditions of the joined rule."""
    on = F.coalesce(F.col("r.lang_group") == F.col("f.lang_group"), F.col("r.lang_group").isNull())
    on &= F.coalesce(F.col("r.language") == F.lower("f.language"), F.col("r.language").isNull())
    if "toggles" in columns:
        for name in ("naming", "logging", "error_handling", "typing"):
            on &= F.coalesce(F.col("r.toggle") != name, F.lit(True)) | F.coalesce(F.col(f"f.toggles.{name}"), F.lit(True))
    if "sector" in columns:
        on &= (F.col("r.kind") != "sector") | F.coalesce(F.col("r.pack") == F.col("f.sector"), F.lit(False))
    return on


def _part(files: DataFrame, rows: list, columns: list[str]) -> DataFrame:
    """Hits of one part of the rule table, with the rules' columns."""
    spark = files.sparkSession
    lookup = spark.sparkContext.broadcast(vars(_Lookup(rows)))  # at most TABLE_BYTES of rules
    names = files.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    named = files.mapInArrow(_named(lookup, names.index("code"), names.index("repo")), kinds + ", wanted array<int>")
    rules = R.small_frame(spark, [{**r.asDict(), "rule_ix": ix} for ix, r in enumerate(rows)], f"rule_ix int, {R.RULE_SCHEMA}, {detect.HOW}")
    rows_of = named.withColumn("rule_ix", F.explode_outer("wanted")).where("rule_ix is not null").alias("f").join(F.broadcast(rules).alias("r"), "rule_ix")
    said = F.coalesce(F.col("f.ai_generated"), F.lit(False)) if "ai_generated" in columns else F.lit(False)
    markers = "(?iu)" + "|".join(re.escape(p.removeprefix("(?i)")) for p in fv.GENERATED_MARKER_PATTERNS)
    generated = F.when(F.col("r.family") == "issues", said | F.col("code").rlike(markers)).otherwise(said)
    due = rows_of.where(_applies(columns)).select(
        *[F.col(f"f.{c}").alias(c) for c in (*detect.KEYS, "code")], generated.alias("generated"), F.expr(regex.mark_sql("code")).alias("mark"), "rule_ix",
        *[F.col(f"r.{n}").alias(n) for n in ("mode", "java", "own", "before", "after")])
    twins = [(ix, r.asDict()) for ix, r in enumerate(rows) if r.mode == "twin"]
    hits = detect.native_hits(due, bool(twins))
    if twins:
        hits = union_findings(hits, detect.twin_hits(due.where("mode = 'twin'"), twins))
    return hits.join(F.broadcast(rules.select("rule_ix", *detect.META)), "rule_ix").drop("rule_ix")


def rule_plan(rules: DataFrame) -> DataFrame:
    """How each rule runs: ``sure`` rules are decided by their literals, ``exists`` and ``spans`` by Java, ``twin`` by Python (``reason``
    says why); ``invalid`` ones are no Python patterns and find nothing."""
    return compiled_table(rules).select("repo", "family", "detector", "pack", "rule_id", "rule_ord", "pattern_ord", "pattern", "mode", "reason")


def detect_table(files: DataFrame, rules: DataFrame, flag_generated: bool = False) -> DataFrame:
    """Findings of a rule table over files, as ``detect.detect`` gives them; the table may be of any size.

    A ``repo`` column of the rules limits a rule to files of that repository (column ``repo`` of the files); a null one
    holds for all.  Patterns that Python rejects find nothing: ``rule_plan`` lists them.  The number of rules
    in the plan is one broadcast table; the rules themselves pass the driver in parts of at most ``TABLE_BYTES``.
    """
    language = text.guess_language(F.col("path"), F.col("language") if "language" in files.columns else None)
    extra = [c for c in ("toggles", "sector", "ai_generated") if c in files.columns]
    repo = F.col("repo").cast("string") if "repo" in files.columns else F.lit(None).cast("string")
    texts = files.select(*detect.KEYS, "code", repo.alias("repo"), language.alias("language"), *extra)
    texts = texts.withColumn("lang_group", text.language_group(F.col("language")))
    table = compiled_table(rules)
    length = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)) for c in ("pattern", "message", "suggestion", "note")), F.lit(100))
    total = _whole(rules).agg(F.sum(length.cast("bigint"))).first()[0] or 0
    parts = max(1, -(-total // TABLE_BYTES))
    place = F.pmod(F.xxhash64("repo", "pack", "rule_id", "rule_ord", "pattern_ord", "pattern"), F.lit(parts))
    found = [_part(texts, table.where(place == p).collect(), extra) for p in range(parts)]
    return detect.findings_of_hits(reduce(DataFrame.unionByName, found), flag_generated)
