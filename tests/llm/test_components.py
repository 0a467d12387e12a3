"""Components of links: each half of a round is a small plan of its own."""

import random

from codesieve.llm import common


def test_plans_of_a_round_stay_small(spark, monkeypatch):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(None, 1), (7, 7)]
    most, real = [], common.written

    def watched(df):
        most.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange "))
        return real(df)

    monkeypatch.setattr(common, "written", watched)
    got = {r.node: r.component for r in common.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    root = {x: x for p in pairs for x in p if None not in p and p[0] != p[1]}
    for _ in root:
        for a, b in pairs:
            if a in root and b in root and a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root
    assert max(most) <= 5, most
