"""Collocations read the texts the same number of times whatever the number of candidates."""

from __future__ import annotations

import random
import string

import pytest

from codesieve.llm import collocations
from test_corpus_order_and_phrases import brute_collocations


def texts(n: int, seed: int) -> list[tuple[str, str]]:
    rng = random.Random(seed)
    names = ["".join(rng.choices(string.ascii_lowercase + "é中", k=rng.randrange(1, 9))) for _ in range(40)]
    return [(rng.choice(["en", "de"]), " ".join(rng.choice(names[:8] if rng.random() < 0.5 else names) + rng.choice(["", "", "", ".", ";"]) for _ in range(rng.randrange(60)))) for _ in range(n)]


@pytest.mark.parametrize("trie_bytes, known, dealt", [(60, 10**6, 32 << 20), (1, 30, 500), (6 << 20, 10**6, 2_000)])
def test_texts_are_read_three_times(spark, monkeypatch, trie_bytes, known, dealt):
    for name, value in (("TRIE_BYTES", trie_bytes), ("KNOWN", known), ("DEALT", dealt)):
        monkeypatch.setattr(collocations, name, value, raising=False)
    rows = texts(150, 8)
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3).mapInArrow(passed, "lang string, text string")
    got = {tuple(r) for r in collocations.collocations(docs, least=3).collect()}
    assert got == brute_collocations(rows, 3, 2000) and len(got) > 100
    assert read.value <= 3 * len(rows)  # size, sketch, windows; one more for each shard of candidates before
