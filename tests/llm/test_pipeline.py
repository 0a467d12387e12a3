"""The pipeline's stages on a small set with planted cases, against a plain version of each decision."""

import pytest

import corpus_pipeline as cp

SHARED = [f"w{i}" for i in range(40)]


@pytest.fixture
def docs(spark):
    clean = "plain words about a river and a stone and the light over water"
    rows = [(1, " ".join(SHARED)), (2, " ".join(SHARED) + " tail"), (3, clean), (4, None), (5, "123 !!"), (6, "note token = abcdefghijklmnop end"),
            (7, "see alpha beta gamma delta here"), (None, clean + " null"), (8, "x" * 50_000)]
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, docs, tmp_path):
    spark.createDataFrame([(1, "alpha beta gamma delta"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = docs
    seen = []
    for _, stage in cp.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == cp.COLUMNS
        seen.append(sorted((r.doc_id or 0) for r in kept.collect()))
    assert seen == [[0, 1, 2, 3, 6, 7, 8], [0, 1, 3, 6, 7, 8], [0, 1, 3, 6, 8], [0, 1, 3, 6, 8]]
    assert {r.doc_id: r.text for r in kept.collect()}[6] == "note [secret] end"
    out = cp.run(spark, str(tmp_path))
    assert sorted((r.doc_id or 0) for r in out.collect()) == seen[-1] and "n_tokens" in out.columns
    assert cp.near_duplicates(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_nothing_of_a_secret_is_left(spark):
    body = [("Q9z+/kW3" * 8)[i:] + "Q9z+/kW3"[:i] for i in range(8)] * 2000
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    lines = "\n".join([*body, "Tail9z=="])
    keys = [f"{begin}\n{lines}\n{end}", f"{begin}\r\n" + lines.replace("\n", "\r\n") + f"\r\n{end}", begin + "\\n" + lines.replace("\n", "\\n") + "\\n" + end,
            f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C\n\n{lines}\n{end}", f"{begin} " + " ".join(body) + f" {end}",
            f"{begin}\n{lines}", f"{begin}\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B2C\n\n{lines}", begin + "\\n" + lines.replace("\n", "\\n"),
            "-----BEGIN PGP PRIVATE KEY BLOCK-----\nVersion: x-y 1\n\n" + lines + "\n=aB3d\n-----END PGP PRIVATE KEY BLOCK-----",
            begin + "\n" + "\n".join("Q9z+/kW3" for _ in range(50)),
            "ghp_" + "aB3" * 200, "xoxb-" + "a1-b" * 200, "sk_live_" + "Zz9" * 200]
    rows = [(i, f"see this:\n{k}\nall other words stay", "en", "s", 0) for i, k in enumerate(keys)]
    rows.append((len(keys), f"a {begin} names a key\nand {begin}\n{lines}\n{end} ends", "en", "s", 0))
    out = {r.doc_id: r.text for r in cp.secret_scan(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "").collect()}
    assert [out[i] for i in range(len(keys))] == ["see this:\n[secret]\nall other words stay"] * len(keys)
    assert out[len(keys)] == "a [secret] names a key\nand [secret] ends"


def test_near_duplicates_of_an_id_on_different_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, b), (5, a), (5, b), (5, c), (5, c), (6, c + " tail"), (8, ""), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted((r.doc_id, r.text) for r in cp.near_duplicates(spark, docs, "").collect()) == [(1, b), (5, a), (5, c), (8, "")]


def test_decontamination_judges_each_row_by_its_own_text(spark, tmp_path):
    leaked, clean = "alpha beta gamma delta here", "plain words about a river"
    spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(5, leaked), (5, clean), (None, leaked), (None, clean), (6, clean), (7, None), (8, ""), (6, clean)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = sorted(((r.doc_id, r.text) for r in cp.decontamination(spark, docs, str(tmp_path)).collect()), key=repr)
    assert kept == sorted([(5, clean), (None, clean), (6, clean), (7, None), (8, ""), (6, clean)], key=repr)
