"""Rewrite and re-scan from a store with generations."""

import os

import pytest
from pyspark.sql import functions as F

from codesieve.operators import detect
from codesieve import rules as R
from codesieve.plans import rewrite
from codesieve.sources import generations


def scanner(files):
    return detect.detect(files, R.security_rules() + R.coding_rules())


def test_changed_files_are_replaced_together(spark, files, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(FileNotFoundError):
        generations.current(spark, path, "files")
    source = files(("b", "a.py", "print(1)\n"), ("b", "c.py", "eval(x)\n"), ("b", "d.py", "x = 1\n"), ("c", "a.py", "print(2)\neval(y)\n"), ("c", "n.py", None))
    rewrite.scan_into(source, path, scanner)
    first = rewrite.report(spark, path).first()
    assert (first.issues, first.coding_issues, first.rewritten, first.exit_code) == (2, 2, 0, 2)
    assert rewrite.backups(spark, path) is None
    assert rewrite.rewrite(spark, path, scanner=scanner) == 2
    second = rewrite.report(spark, path).first()
    assert (second.issues, second.coding_issues, second.rewritten, second.total, second.exit_code) == (2, 0, 2, 2, 2)
    texts = {(r.batch_id, r.path): r.code for r in generations.current(spark, path, "files").collect()}
    assert len(texts) == 5 and "logger.info(1)" in texts["b", "a.py"] and texts["b", "c.py"] == "eval(x)\n" and texts["c", "n.py"] is None
    assert {(r.batch_id, r.path, r.code) for r in rewrite.backups(spark, path).collect()} == {("b", "a.py", "print(1)\n"), ("c", "a.py", "print(2)\neval(y)\n")}

    def without_eval(rows):
        return rows.withColumn("original", F.col("code")).withColumn("code", F.replace("code", F.lit("eval("), F.lit("run("))).withColumn("changes", F.array(F.lit("no_eval")))

    assert rewrite.rewrite(spark, path, without_eval, scanner) == 2
    third = rewrite.report(spark, path).first()
    assert (third.total, third.rewritten, third.exit_code) == (0, 3, 0)
    rows = {(r.batch_id, r.path): (r.changes, r.issues, r.coding) for r in rewrite.file_report(spark, path).collect()}
    assert rows["c", "a.py"] == (["no_eval"], 0, 0) and rows["b", "d.py"] == ([], 0, 0) and len(rows) == 5
    assert sorted(os.listdir(path)) == sorted(["commits", *[os.path.basename(f) for f in generations.folders(spark, path)]])


def test_a_generation_without_a_commit_is_not_seen(spark, files, tmp_path):
    path = str(tmp_path / "store")
    rewrite.scan_into(files("print(1)\n"), path, scanner)

    def broken(rows):
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        rewrite.rewrite(spark, path, scanner=broken)
    assert len(generations.folders(spark, path)) == 1 and rewrite.report(spark, path).first().coding_issues == 1
    assert rewrite.rewrite(spark, path, scanner=scanner) == 1 and rewrite.report(spark, path).first().total == 0
