"""Batches whose files arrive over several micro-batches, with restarts, repeats and batches that never end."""

import pytest

from codesieve.plans.scan import scan, verdicts
from codesieve.streaming import batches

FILES = "batch_id string, file_ord bigint, path string, code string, n_files bigint, ts timestamp"
BLOCK = "\n".join(f"some shared line number {i} of the block, long enough to count" for i in range(8))


def arrivals():
    """(micro-batch, row): batch a comes in three parts, b at once, c never ends, d repeats a file."""
    out = []
    for i, part in enumerate([0, 1, 2]):
        out.append((part, ("a", i, f"a{i}.py", f"{BLOCK}\nx{i} = 1\n" + ('password = "abcdefgh"\n' if i == 2 else ""), 3, f"2024-01-01 00:0{part}:00")))
    out += [(1, ("b", i, f"b{i}.py", "print(1)\n", 2, "2024-01-01 00:01:00")) for i in range(2)]
    out += [(0, ("c", 0, "c0.py", "eval(x)\n", 5, "2024-01-01 00:00:30")), (1, ("c", 3, "c3.py", "x\n", None, "2024-01-01 00:01:30"))]
    out += [(0, ("d", 0, "d0.py", "x\n", 2, "2024-01-01 00:00:00")), (1, ("d", 0, "d0.py", "x\n", 2, "2024-01-01 00:01:00")), (2, ("d", 1, "d1.py", "print(2)\n", 2, "2024-01-01 00:02:00"))]
    out += [(3, ("e", 0, "e0.py", "x\n", 1, "2024-01-02 00:00:00")), (4, ("f", 0, "f0.py", "x\n", 1, "2024-01-02 00:00:01"))]
    return out


@pytest.mark.parametrize("restart", [False, True])
def test_one_verdict_per_batch(spark, tmp_path, restart):
    def put(part):
        from datetime import datetime

        rows = [(*r[:5], datetime.fromisoformat(r[5])) for p, r in arrivals() if p == part]
        spark.createDataFrame(rows, FILES).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def run():
        source = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        batches.store_files(source, str(tmp_path / "stored"), str(tmp_path / "check1")).awaitTermination()
        q = batches.scan_ended_batches(spark, str(tmp_path / "stored"), FILES, str(tmp_path / "found"), str(tmp_path / "verdicts"), str(tmp_path / "check2"),
                                       idle_seconds=3600, delay="1 minute")
        q.awaitTermination()

    for part in range(5):
        put(part)
        if restart:
            run()
    if not restart:
        run()
    got = [(r.batch_id, r.policy, r.files_scanned, r.complete) for r in spark.read.parquet(str(tmp_path / "verdicts" / "verdicts")).collect()]
    whole = spark.createDataFrame([r[:4] for _, r in arrivals()], "batch_id string, file_ord bigint, path string, code string").dropDuplicates(["batch_id", "file_ord"])
    found = scan(whole)
    want = {r.batch_id: (r.policy, r.files_scanned) for r in verdicts(whole, found)[1].collect()}
    assert sorted(got) == sorted((b, *want[b], b != "c") for b in want) and want["a"] == ("blocking", 3)
    stored = spark.read.parquet(str(tmp_path / "found"))
    copies = stored.where("batch_id = 'a' and type = 'ip_cross_file_duplicate'").count()
    assert copies == found.where("batch_id = 'a' and type = 'ip_cross_file_duplicate'").count() > 0
