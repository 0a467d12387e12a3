"""The stored audit log: numbering, chains over several appends, conflicts, tampering, reports."""

import hashlib
import hmac
import json
import os

import pytest
from pyspark.sql import functions as F

from codesieve.operators import audit as au
from codesieve.operators import reports
from codesieve.sources import audit_log, readers, writers

KEY = b"test key"


def entries(spark, names, policy="warning"):
    return spark.createDataFrame([(n, policy) for n in names], "request_id string, policy string").withColumn(
        "output", F.struct(F.struct(F.lit(2).alias("issues"), F.lit(0).alias("coding")).alias("counts")))


def lines_of(spark, path):
    return sorted((json.loads(r.value) for r in spark.read.text(audit_log._folders(spark, path)).collect()), key=lambda e: (e["lane"], e["pos"]))


@pytest.mark.parametrize("lanes", [1, 4])
def test_chains_go_on_over_appends(spark, tmp_path, lanes):
    path = str(tmp_path / "audit")
    for part in range(3):
        end = audit_log.append(entries(spark, [f"r{part}-{i}" for i in range(20)]), path, KEY, lanes=lanes)
    assert end.epoch == 2 and end == audit_log.head(spark, path) and sum(pos + 1 for pos, _ in end.last.values()) == 60
    rows = lines_of(spark, path)
    assert len({r["seq"] for r in rows}) == 60 and len({r["audit_id"] for r in rows}) == 60
    prev = {}
    for row in rows:  # the chain, written out
        body = {k: v for k, v in row.items() if k not in audit_log.PLACED}
        before = prev.get(row["lane"])
        want = hmac.new(KEY, json.dumps({**body, "prev_hash": before}, sort_keys=True).encode(), hashlib.sha256).hexdigest()
        assert (row["prev_hash"], row["hash"]) == (before, want)
        prev[row["lane"]] = want
    epochs = [r.request_id[1] for r in audit_log.read(spark, path).orderBy("seq").collect()]
    assert epochs == sorted(epochs)
    checked = audit_log.verify(spark, path, KEY).collect()
    assert len(checked) == 60 and all(r.hash_ok and r.link_ok for r in checked)
    assert not any(r.hash_ok for r in audit_log.verify(spark, path, b"other key").collect())


def test_changed_removed_and_reordered_rows_are_found(spark, tmp_path):
    path = str(tmp_path / "audit")
    for part in range(2):
        audit_log.append(entries(spark, [f"r{part}-{i}" for i in range(6)]), path, KEY, lanes=1)
    rows = lines_of(spark, path)

    def verified(changed):
        other = str(tmp_path / f"copy{len(os.listdir(tmp_path))}")
        os.makedirs(f"{other}/commits")
        for name in os.listdir(f"{path}/commits"):
            if name.endswith(".json"):
                (tmp_path / other / "commits" / name).write_bytes((tmp_path / "audit" / "commits" / name).read_bytes())
        for c in audit_log.commits(spark, path).collect():
            os.makedirs(f"{other}/log/{c.folder}")
            own = [r for r in changed if r["seq"] // audit_log.EPOCH_ROWS == c.epoch]
            with open(f"{other}/log/{c.folder}/part.txt", "w") as f:
                f.writelines(json.dumps(r) + "\n" for r in own)
        return sorted((r.pos, r.hash_ok, r.link_ok) for r in audit_log.verify(spark, other, KEY).collect())

    fine = [(i, True, True) for i in range(12)]
    assert verified(rows) == fine
    assert verified([r | {"policy": "advisory"} if r["pos"] == 3 else r for r in rows]) == [(i, i != 3, True) for i in range(12)]
    assert verified([r for r in rows if r["pos"] != 4]) == [(i, True, i != 5) for i in range(12) if i != 4]
    assert verified(rows[:-1]) == fine[:-1] + [(11, False, False)]


def test_a_conflicting_append_starts_again(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "audit")
    audit_log.append(entries(spark, ["a"]), path, KEY, lanes=2)
    true_head, stale = audit_log.head, [audit_log.head(spark, path)]
    audit_log.append(entries(spark, ["b"]), path, KEY)
    monkeypatch.setattr(audit_log, "head", lambda *a: stale.pop() if stale else true_head(*a))
    assert audit_log.append(entries(spark, ["c"]), path, KEY).epoch == 2
    assert sorted(r.request_id for r in audit_log.read(spark, path).collect()) == ["a", "b", "c"]
    assert all(r.hash_ok and r.link_ok for r in audit_log.verify(spark, path, KEY).collect())
    assert len(os.listdir(f"{path}/log")) == 3
    old = audit_log.Head(0, 2, {})
    monkeypatch.setattr(audit_log, "head", lambda *a: old)
    with pytest.raises(audit_log.Conflict):
        audit_log.append(entries(spark, ["d"]), path, KEY, tries=2)


def test_folders_without_a_commit_do_not_count(spark, tmp_path):
    path = str(tmp_path / "audit")
    assert audit_log.read(spark, path).count() == 0 and audit_log.verify(spark, path, KEY).count() == 0
    audit_log.append(entries(spark, ["a", "b"]), path)
    os.makedirs(f"{path}/log/epoch=1-left")
    (tmp_path / "audit" / "log" / "epoch=1-left" / "part.txt").write_text('{"audit_id": "x"}\n')
    rows = readers.read_audit(spark, path).collect()
    assert sorted(r.request_id for r in rows) == ["a", "b"] and all(r.hash is None and r.prev_hash is None for r in rows)
    assert audit_log.append(entries(spark, []), path).epoch == 1 and audit_log.read(spark, path).count() == 2


def test_reports_read_what_is_written(spark, tmp_path, files):
    path = str(tmp_path / "audit")
    source = files(("b1", "a.py", 'password = "abcdefgh"\nprint(1)\n'), ("b2", "b.py", "x = 1\n"))
    from codesieve.plans.scan import scan, verdicts

    found = scan(source)
    batches = source.select("batch_id").distinct().withColumn("repo", F.lit("r")).withColumn("ai_api_key", F.lit("secret"))
    writers.append_audit(au.audit_rows(batches, verdicts(source, found)[1], found), path, found, KEY, source)
    first = readers.read_audit(spark, path)
    assert "secret" not in str(first.collect()) and json.loads(first.first().input)["ai_api_key"] == "<redacted>"
    ids = {r.request_id: r.audit_id for r in first.collect()}
    for answer in ("accepted", "rejected"):
        writers.append_resolution(spark.createDataFrame([(ids["b1"], answer, "me"), ("", "x", "me")], "audit_id string, resolution string, actor string"), path, KEY)
    log = readers.read_audit(spark, path)
    assert log.count() == 4
    assert {(r.request_id, r.resolution, r.actor) for r in au.latest_resolution(log).collect()} == {("b1", "rejected", "me"), ("b2", "unresolved", None)}
    total = reports.summary(log).first()
    assert (total.total_requests, total.blocking, total.issues, total.coding) == (2, 1, 1, 1)
    assert [r.policy for r in reports.recent(log, 2).collect()] == ["", ""] and reports.recent(log, 10).count() == 4
    assert sorted((r.request_id, r.path, r["size"]) for r in spark.read.parquet(path + "/input").collect()) == [("b1", "a.py", 31), ("b2", "b.py", 6)]
    assert all(r.hash_ok and r.link_ok for r in audit_log.verify(spark, path, KEY).collect())
