"""What larger tables asked for: whole jobs, and work that grows no faster than the input."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F


def documents(spark, folder, rows):
    """A ``documents`` table from (doc_id, text, source)."""
    data = [(i, text, "en", source, len(text)) for i, text, source in rows]
    spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_review_comments_reach_every_line(spark, tmp_path):
    from checks.all import QUERIES

    # documents 1, 18 and 35 get the snippet with an SQL injection in its first line
    sf = documents(spark, tmp_path, [(17 * k + 1, "\n".join("ab"[: k + 1]), "src0") for k in range(2)] + [(35, "a\nb\nc", "src0")])
    found = QUERIES["J7_J8_L3_review_comments"](spark, sf).collect()
    lines = {(r.path.split("/")[1].split(".")[0], r.line) for r in found}
    assert {("1", 2), ("18", 3), ("35", 4)} <= lines


def test_window_counts_are_running_sums(spark):
    from codesieve.operators import limiter

    start = datetime(2024, 1, 1)
    seconds = [0, 1, 1, 9, 10, 11, 11, 19, 20, 21, 35, 3600, None]
    rows = [(c, None if s is None else start + timedelta(seconds=s), 100 * c + i) for c in (1, 2) for i, s in enumerate(seconds) if c == 1 or i % 2]
    requests = spark.createDataFrame(rows, "client int, ts timestamp, id int")
    found = limiter.window_counts(requests, 10)
    expected = {i: sum(1 for d, u, _ in rows if u is not None and d == c and timedelta(0) <= t - u < timedelta(seconds=10)) for c, t, i in rows if t is not None}
    assert {r.id: r.in_window for r in found.collect()} == expected
    # a frame with two moving ends is counted anew for every row: quadratic in the rows of a bucket
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "unboundedpreceding" in plan and "-9999999" not in plan


def test_reports_scan_once(spark, tmp_path, monkeypatch):
    from checks import events, logs
    from checks.all import QUERIES

    sf = documents(spark, tmp_path, [(i, f"line {i}", "src1") for i in range(20)])
    scans = []
    plain = logs.scan
    monkeypatch.setattr(logs, "scan", lambda *a, **k: scans.append(1) or plain(*a, **k))
    for name in ("K1_scan_report", "K2_audit_rows", "F21_summary_text"):
        found = QUERIES[name](spark, sf)
        assert not any("rlike" in p or "regexp" in p for p in [found._jdf.queryExecution().optimizedPlan().toString().lower()]), name
        assert not found.isEmpty()
    assert len(scans) == 3 and not hasattr(events, "scan")


def test_reviewer_gets_texts_one_at_a_time_from_arrow(spark, files):
    from codesieve.operators import review

    asked = files("x", "eval(", "é" * 3).select("batch_id", "file_ord", "path", F.col("code").alias("prompt"))
    asked = asked.unionByName(spark.createDataFrame([(None, None, None, "y")], asked.schema))

    def reviewer(text):
        if "eval(" in text:
            raise RuntimeError("refused")
        return text * 2

    found = review.ask(asked, reviewer)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()  # no frame of all texts of a batch as Python objects
    assert {tuple(r) for r in found.collect()} == {("b", 0, "f0.py", "xx", None), ("b", 1, "f1.py", None, "refused"), ("b", 2, "f2.py", "é" * 6, None), (None, None, None, "yy", None)}


def test_exported_log_is_compressed(spark, tmp_path):
    from codesieve.sources import readers, writers

    rows = spark.range(2000).selectExpr("cast(id as string) audit_id", "'2024-01-01T00:00:00.000000Z' timestamp", "'blocking' policy")
    writers.export_audit(rows, f"{tmp_path}/log")
    written = sum(p.stat().st_size for p in (tmp_path / "log").glob("part-*"))
    plain = sum(len(line) + 1 for line in rows.toJSON().collect())
    assert written * 3 < plain
    assert readers.read_audit(spark, f"{tmp_path}/log").select("audit_id", "policy").exceptAll(rows.select("audit_id", "policy")).isEmpty()


def test_language_steps_are_small_and_texts_go_once(spark):
    from codesieve.llm import langid

    rows = [(i, f"the word {i} is here " * 9, "en", "s", 1) if i % 2 else (i, f"das wort {i} ist hier " * 9, "de", "s", 1) for i in range(40)]
    docs = spark.createDataFrame([*rows, (41, None, "en", "s", 1), (42, "1 2", None, "s", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    tagger = langid.fit(docs)
    kept = langid.predict(docs, tagger, keep=["doc_id", "text", "lang"])
    sent = kept._jdf.queryExecution().optimizedPlan().toString()
    map_line = next(line for line in sent.splitlines() if "Project" in line and "RLIKE" in line)
    assert map_line.count("text#") == 2  # as a kept column and in the test for letters
    plain = {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in langid.predict(docs, tagger).collect()}
    assert {r.doc_id: (r.lang_pred, round(r.score, 9)) for r in kept.collect()} == plain
    assert plain[41] == plain[42] == ("und", 0.0) and plain[1][0] == "en" and plain[2][0] == "de"
    assert {r.doc_id: r.text for r in kept.collect()} == {r.doc_id: r.text for r in docs.collect()}
    assert langid.LABEL_BYTES <= 1 << 20
