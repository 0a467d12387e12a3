"""Limiter, chain, running totals, readers, writers, reviewer, fixes and streams."""

import json
import random

import pytest
from pyspark.sql import functions as F

from codesieve.functions import text
from codesieve.operators import audit as au
from codesieve.operators import fixes, limiter, options, review, selection
from codesieve.operators import selection, skew
from codesieve.operators.skew import first_n, ordered_running, salted_join
from codesieve.rules import pack_rules, rules_frame
from codesieve.sources import readers, writers
from codesieve.streaming import jobs


def brute_admissions(rows, window, limit):
    out, taken = {}, {}
    for client, us, i in sorted(rows, key=lambda r: (r[1], r[2])):
        kept = [t for t in taken.get(client, []) if us - t < window * 1_000_000]
        out[i] = len(kept) < limit
        taken[client] = kept + [us] if out[i] else kept
    return out


@pytest.mark.parametrize("seed,limit", [(1, 3), (2, 1), (3, 8), (4, 40)])
def test_admissions(spark, seed, limit):
    rng = random.Random(seed)
    rows = [(rng.choice([1, 1, 1, 2, 3]), rng.randrange(0, 300_000_000, 500_000), i) for i in range(800)]
    df = spark.createDataFrame(rows, "client int, us bigint, id bigint").withColumn("ts", F.timestamp_micros("us")).select("client", "ts", "id")
    got = {r.id: r.admitted for r in limiter.admissions(df, 10, limit).collect()}
    assert got == brute_admissions(rows, 10, limit)


def test_window_counts(spark):
    rng = random.Random(5)
    rows = [(rng.choice([1, 2]), rng.randrange(0, 60_000_000, 1_000_000), i) for i in range(200)]
    df = spark.createDataFrame(rows, "client int, us bigint, id bigint").withColumn("ts", F.timestamp_micros("us"))
    got = {r.id: r.in_window for r in limiter.window_counts(df.select("client", "ts", "id"), 10).collect()}
    want = {i: sum(c2 == c and 0 <= us - u2 < 10_000_000 for c2, u2, _ in rows) for c, us, i in rows}
    assert got == want


def test_admission_stream_over_batches(spark, tmp_path):
    rng = random.Random(6)
    rows = sorted(((rng.choice([1, 2]), rng.randrange(0, 200_000_000, 500_000), i) for i in range(300)), key=lambda r: (r[1], r[2]))
    rows = [(c, us, i) for i, (c, us, _) in enumerate(rows)]
    for k in range(3):  # one file per micro-batch, in time order
        part = spark.createDataFrame(rows[k * 100:(k + 1) * 100], "client bigint, us bigint, id bigint").withColumn("ts", F.timestamp_micros("us"))
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("client bigint, us bigint, id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.append_files(jobs.admission_stream(stream, 10, 3), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == brute_admissions(rows, 10, 3)


@pytest.mark.parametrize("held", [100_000, 5])
def test_admission_state_ends(spark, tmp_path, held):
    rng = random.Random(8)
    parts = [[(c, us + rng.randrange(1000), 1000 * k + i) for i, (c, us) in enumerate((c, us) for c in clients for us in range(start, start + 40_000_000, 1_000_000))]
             for k, (clients, start) in enumerate([((1, 2), 0), ((2,), 50_000_000), ((2, 3), 200_000_000), ((3,), 400_000_000)])]
    for part in parts:
        rng.shuffle(part)
        frame = spark.createDataFrame(part, "client bigint, us bigint, id bigint").withColumn("ts", F.timestamp_micros("us"))
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("client bigint, us bigint, id bigint, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        jobs.append_files(jobs.admission_stream(stream, 10, 3, "1 second", held), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = {r.id: r.admitted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == brute_admissions([r for part in parts for r in part], 10, 3)
    state = spark.read.format("statestore").option("stateVarName", "taken").load(str(tmp_path / "cp")).selectExpr("key.client as client").collect()
    assert {r.client for r in state} <= {3}


def test_chain_finds_the_altered_row(spark):
    rows = spark.createDataFrame([(s, i, json.dumps({"b": i, "a": "ü", "n": None})) for s in (0, 1) for i in range(20)],
                                 "segment bigint, seq bigint, entry string")
    log = spark.createDataFrame(au.write_chain(rows, b"key").collect())
    ok = au.verify_chain(log, b"key").collect()
    assert len(ok) == 40 and all(r.hash_ok and r.link_ok for r in ok)
    first = log.where("segment = 1 and seq = 0").collect()[0]
    assert first.prev_hash is None
    import hashlib
    import hmac

    body = json.dumps({"b": 0, "a": "ü", "n": None, "prev_hash": None}, sort_keys=True).encode()
    assert first["hash"] == hmac.new(b"key", body, hashlib.sha256).hexdigest()
    forged = log.withColumn("entry", F.when((F.col("segment") == 1) & (F.col("seq") == 7), '{"b": 8}').otherwise(F.col("entry")))
    bad = au.verify_chain(forged, b"key").where("not hash_ok or not link_ok").collect()
    assert [(r.segment, r.seq, r.hash_ok) for r in bad] == [(1, 7, False)]
    cut = au.verify_chain(log.where("not (segment = 0 and seq = 5)"), b"key").where("not link_ok").collect()
    assert [(r.segment, r.seq) for r in cut] == [(0, 6)]
    assert au.verify_chain(log, b"other").where("hash_ok").count() == 0


@pytest.mark.parametrize("descending", [False, True])
def test_ordered_running(spark, descending):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), i * 3, rng.randint(1, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, o bigint, v int")
    got = {(r.k, r.o): r.t for r in ordered_running(df, ["k"], "o", F.col("v"), "t", descending, bucket=16).collect()}
    want = {(k, o): sum(v2 for k2, o2, v2 in rows if k2 == k and (o2 >= o if descending else o2 <= o)) for k, o, v in rows}
    assert got == want


def test_hashed_positions_are_numbered_in_even_ranges(spark):
    files = spark.range(20_000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("b"), F.col("id") % 50)).alias("batch_id"), F.xxhash64("id").alias("file_ord"))
    cuts = skew.order_cuts(files, "file_ord", 16)
    sizes = files.groupBy(skew._place("file_ord", cuts).alias("p")).count().collect()
    assert len(cuts) == 15 and len(sizes) == 16 and max(r["count"] for r in sizes) < 2 * 20_000 / 16
    numbered = skew.ordered_running(files, ["batch_id"], "file_ord", F.lit(1), "rn", bucket=None, parts=16)
    got = {(r.batch_id, r.file_ord): r.rn for r in numbered.collect()}
    by_batch = {}
    for b, o in sorted(got):
        by_batch.setdefault(b, []).append(o)
    assert got == {(b, o): i for b, orders in by_batch.items() for i, o in enumerate(orders, 1)}
    chunks = selection.chunk_numbers(files, 100).groupBy("batch_id", "chunk").count().where("batch_id = 'hot'").collect()
    assert sorted(r["count"] for r in chunks)[1:] == [100] * (len(chunks) - 1)
    assert skew.ordered_number(files.where("false"), ["batch_id"], "file_ord", bucket=None).count() == 0


@pytest.mark.parametrize("buckets", [4096, 2, 7])
def test_retention_keeps_the_newest_rows(spark, monkeypatch, buckets):
    monkeypatch.setattr(au, "CUT_BUCKETS", buckets)
    rng = random.Random(9)
    rows = [((1 << 55) + i * rng.randrange(1, 1 << 30), rng.randrange(0, 60)) for i in range(500)]
    rows = list({s: (s, n) for s, n in rows}.values())
    log = spark.createDataFrame(rows, "seq bigint, bytes bigint")
    for most, segments in ((100, 3), (1, 0), (10**6, 1), (37, 5)):
        got = {r.seq: (r.running, r.segment_no) for r in au.retained(log, F.col("bytes"), most, segments).collect()}
        want, running = {}, 0
        for s, n in sorted(rows, reverse=True):
            running += n
            if running <= most * (segments + 1):
                want[s] = (running, (running - 1) // most)
        assert got == want
    assert au.retained(log.where("false"), F.col("bytes"), 10).count() == 0
    assert au.retained(log, F.col("bytes"), 0).count() == len(rows)
    plan = au.retained(log, F.col("bytes"), 100, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "seq#" in plan and ">= " in plan


def test_salted_join_and_first_n(spark):
    left = spark.range(1000).selectExpr("'hot' as k", "id as file_ord").unionByName(spark.range(3).selectExpr("'none' as k", "id as file_ord"))
    dim = spark.createDataFrame([("hot", 7)], "k string, v int")
    out = salted_join(left, dim, ["k"], "file_ord")
    assert out.count() == 1003 and out.where("v = 7").count() == 1000
    top = first_n(left, ["k"], [F.col("file_ord")], 2)
    assert sorted((r.k, r.file_ord) for r in top.collect()) == [("hot", 0), ("hot", 1), ("none", 0), ("none", 1)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().toString()


def test_read_tree(spark, tmp_path):
    for name, body in {"a.py": b"x\xff\xfey", "sub/b.TS": b"ok", "sub/.git/c.py": b"no", "node_modules/d.js": b"no", "e.txt": b"no",
                       "mydist/f.go": b"yes", "sp ace+%41.md": "ü".encode(), "dist.py": b"yes", "sub/__init__.py": b"yes", ".ci/x.yml": b"yes"}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(body)
    visible = {"a.py": "xy", "sub/b.TS": "ok", "mydist/f.go": "yes", "sp ace+%41.md": "ü", "dist.py": "yes"}
    hidden = {"sub/__init__.py": "yes", ".ci/x.yml": "yes"}
    assert {r.path: r.code for r in readers.read_tree(spark, str(tmp_path)).collect()} == visible | hidden
    assert {r.path: r.code for r in readers.read_tree(spark, str(tmp_path), listing="spark").collect()} == visible
    assert {r.path: r.code for r in readers.read_tree(spark, str(tmp_path), listing="source").collect()} == visible | hidden
    for listing in ("walk", "source"):
        assert readers.read_tree(spark, str(tmp_path), extensions=[], exclude_dirs=[], listing=listing).count() == 10
        assert readers.read_tree(spark, str(tmp_path), max_bytes=2, listing=listing).count() == 2
    assert readers.read_tree(spark, str(tmp_path), max_bytes=2).count() == 2


def test_a_flat_folder_is_read_by_all_tasks(spark, tmp_path):
    for i in range(3000):
        (tmp_path / f"f{i}.py").write_text("x" * (i % 50))
    (tmp_path / "large.py").write_text("y" * 200_000)
    found = readers.read_tree(spark, str(tmp_path), listing="source").withColumn("task", F.spark_partition_id())
    rows = found.groupBy("task").agg(F.count("*").alias("n"), F.sum(F.length("code")).alias("chars")).collect()
    assert len(rows) == 2 * spark.sparkContext.defaultParallelism and sum(r.n for r in rows) == 3001
    assert sorted(r.chars for r in rows)[-1] == 200_000 and max(r.chars for r in rows if r.chars < 200_000) < 2 * 73_500 / len(rows)
    (tmp_path / "none").mkdir()
    assert readers.read_tree(spark, str(tmp_path / "none"), listing="source").count() == 0


def test_partitions_hold_even_bytes():
    from codesieve.sources.tree_source import packed

    rng = random.Random(1)
    sizes = [rng.choice([0, 10, 1000, 100_000]) for _ in range(2000)]
    parts = packed(sizes, 7, most_bytes=2_000_000, most_files=100)
    assert sorted(i for p in parts for i in p) == list(range(2000)) and max(map(len, parts)) <= 100
    sums = sorted(sum(sizes[i] for i in p) for p in parts)
    assert sums[-1] - sums[0] <= 100_000 and len(parts) >= sum(sizes) // 2_000_000
    assert packed([], 3) == [] and packed([5], 3) == [[0]]


def test_audit_read_modes(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"audit_id": "a", "policy": "warning"}\n{broken\n{"audit_id": "b"}\n')
    loose = readers.read_audit(spark, str(tmp_path / "log.json"), strict=False)
    assert [r.audit_id for r in loose.collect()] == ["a", "b"]
    with pytest.raises(Exception, match="(?i)malformed"):
        readers.read_audit(spark, str(tmp_path / "log.json")).collect()


def test_audit_append_and_resolution(spark, tmp_path):
    rows = spark.createDataFrame([("r1", "warning")], "request_id string, policy string")
    writers.append_audit(rows, str(tmp_path / "audit"))
    first = spark.read.json(str(tmp_path / "audit" / "log")).collect()[0]
    asked = spark.createDataFrame([(first.audit_id, "accepted", "me"), ("", "x", "me"), ("a", None, "me")], "audit_id string, resolution string, actor string")
    writers.append_resolution(asked, str(tmp_path / "audit"))
    log = spark.read.json(str(tmp_path / "audit" / "log")).withColumn("seq", F.monotonically_increasing_id())
    assert log.count() == 2
    done = au.latest_resolution(log.withColumn("resolution", F.coalesce("resolution", F.lit("unresolved")))).collect()
    assert [(r.resolution, r.actor) for r in done] == [("accepted", "me")]


def test_rulepacks(spark, tmp_path):
    path = str(tmp_path / "rules")
    rule = {"id": "R", "type": "t", "message": "m", "severity": "warning", "pattern": ["a", "", "b"]}
    writers.upsert_rulepack(rules_frame(spark, pack_rules("one", [rule])), path, "one")
    writers.upsert_rulepack(rules_frame(spark, pack_rules("two", [rule])), path, "two")
    writers.upsert_rulepack(rules_frame(spark, pack_rules("one", [{**rule, "pattern": "c"}])), path, "one")
    assert [r.pack for r in readers.list_rulepacks(readers.read_rulepacks(spark, path)).collect()] == ["one", "two"]
    assert sorted(r.pattern for r in readers.read_rulepacks(spark, path, "one").collect()) == ["c"]
    assert readers.read_rulepacks(spark, path, "none").count() == 0
    with pytest.raises(ValueError):
        writers.upsert_rulepack(rules_frame(spark, []), path, "bad name")


HEADERS = ["", "#!/bin/x\n", "# coding\n\n", '"""doc"""\n', '"""doc\nmore\n"""\nimport os\nfrom a import b\n\nx = 1\n', "'''open\nnever closed\n", "import logging\n",
           "logger = logging.getLogger(__name__)\n", "import os\n\nimport sys\n"]


@pytest.mark.parametrize("head", HEADERS)
def test_safe_fix(files, head):
    code = head + "print(1)\n"
    rows = fixes.safe_fix(files(("b", "a.py", code), ("b", "a.js", code), ("b", "c.py", head))).collect()
    by_path = {r.path: r for r in rows}
    fixed = by_path["a.py"]
    assert fixed.changes == ["replace_print_with_logger"] and fixed.original == code
    assert "logger.info(1)" in fixed.code and fixed.code.count("import logging") == 1
    assert fixed.code.count("logging.getLogger(__name__)") == 1
    assert by_path["a.js"].code == code and by_path["c.py"].changes == []


LOGGER = "\nlogger = logging.getLogger(__name__)\n"


@pytest.mark.parametrize("code, expected", [
    ("#!/x\n# coding\n\n'''d'''\nimport os\n\nf()\n", "#!/x\n# coding\n\n'''d'''\nimport logging\nimport os\n" + LOGGER + "\nf()\n"),
    ("x\n", "import logging\n" + LOGGER + "x\n"),
    ("", "import logging\n" + LOGGER),
    ('"""a\nb\n', '"""a\nb\nimport logging\n' + LOGGER),
    ('"""a\nb""" # c\nfrom a import b\n  import c\n\nimport logging\nx\nimport d\n',
     '"""a\nb""" # c\nfrom a import b\n  import c\n\nimport logging\n' + LOGGER + "x\nimport d\n"),
    ("import logging\nlog = logging.getLogger(__name__)\n", "import logging\nlog = logging.getLogger(__name__)\n"),
    ("\n\n  \nf()\n" * 2, "\n\n  \nimport logging\n" + LOGGER + "f()\n\n\n  \nf()\n"),
])
def test_logger_placement(spark, code, expected):
    frame = spark.createDataFrame([(code,)], "code string")
    assert frame.select(fixes.with_logger(F.col("code"))).first()[0] == expected


def test_rewrite_and_errors(files):
    f = files("a = 1", " ", "boom").withColumn("findings_json", F.lit("[]"))

    def rewriter(prompt):
        if "boom" in prompt:
            raise RuntimeError("no")
        return "```python\na = 2\n```"

    rows = {r.path: r for r in review.rewrite(f, rewriter).collect()}
    assert rows["f0.py"].updated == "a = 2" and rows["f1.py"].updated == " "
    assert rows["f2.py"].updated == "boom" and rows["f2.py"].error == "no"


@pytest.mark.parametrize("answer,want", [
    ('[{"type": "a"}]', ["a"]), ('{"findings": [{"type": "b"}, 3]}', ["b"]), ("```json\n[]\n```", []), ('say [{"message": "m"}] end', ["ai_review"]),
    ("5", []), ('{"x": 1}', []), ("none", ["ai_review_error"]), ("[broken", ["ai_review_error"]), ('{"findings": "x"}', []), ("", ["ai_review_error"]),
])
def test_answers(spark, answer, want):
    df = spark.createDataFrame([("b", 0, "p", answer, None)], "batch_id string, file_ord bigint, path string, answer string, error string")
    assert [r.type for r in review.answers_to_findings(df).collect()] == want


def test_toggles(spark):
    on = "named_struct('naming', {0}, 'logging', {1}, 'error_handling', {2}, 'typing', {3})"
    flat = F.expr(on.format("false", "cast(null as boolean)", "cast(null as boolean)", "false"))
    empty = F.expr(on.format(*["cast(null as boolean)"] * 4))
    langs = F.expr("map('go', " + on.format("true", "false", "true", "true") + ")")
    row = spark.range(1).select(
        options.resolve_toggles(flat, langs, F.lit("go")).alias("a"), options.resolve_toggles(empty, langs, F.lit("go")).alias("b"),
        options.resolve_toggles(empty, langs, F.lit("java")).alias("c")).collect()[0]
    assert tuple(row.a) == (False, True, True, False)
    assert tuple(row.b) == (True, False, True, True)
    assert tuple(row.c) == (True, True, True, True)


def test_change_set_caps_after_filters(spark):
    rows = [("b", i, f"p{i}.py", "removed" if i % 2 else "added", "x" * (5 if i % 3 else 50)) for i in range(60)]
    df = spark.createDataFrame(rows, "batch_id string, file_ord bigint, path string, status string, code string")
    got = sorted(r.file_ord for r in selection.change_set(df, 5, 10).collect())
    assert got == [i for i in range(60) if i % 2 == 0 and i % 3][:5]


def test_hmac_long_key(spark):
    import hashlib
    import hmac

    key = b"k" * 100
    got = spark.range(1).select(text.hmac_sha256(key, F.lit("meß")).alias("h")).collect()[0].h
    assert got == hmac.new(key, "meß".encode(), hashlib.sha256).hexdigest()


def test_change_event_end_to_end(spark):
    from codesieve.plans.change_event import report

    rows = spark.createDataFrame(
        [("pr", 0, "a.py", "modified", "eval(x)\nprint(1)\n", "@@ -1 +1,1 @@\n+eval(x)\n"), ("pr", 1, "b.py", "removed", "eval(x)", ""), ("pr", 2, "c.bin", "added", "eval(x)", "")],
        "batch_id string, file_ord bigint, path string, status string, code string, patch string")
    meta = spark.createDataFrame([("pr", "by copilot", None, ["scan-override"], ["m"], None, None, None)],
                                 "batch_id string, title string, body string, labels array<string>, commit_messages array<string>,"
                                 " config_labels array<string>, config_ai_generated boolean, env_value string")
    out = report(rows, meta)
    s = out["summary"].collect()[0]
    assert (s.policy, s.files_scanned, s.conclusion, s.issues) == ("blocking", 1, "success", 2)
    assert s.summary.startswith("Policy: blocking (override applied)\nFiles scanned: 1\nSecurity issues: 2")
    assert [r.line for r in out["comments"].orderBy("body").collect()] == [1, 1]
    assert {r.start_line for r in out["annotations"].collect()} == {1, 2}
