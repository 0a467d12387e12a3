"""Duplicates against plain loops, with hot blocks, repeated paths and any number of partitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from codesieve.operators import duplicates


def brute_lines(code):
    seen, out = {}, []
    for n, line in enumerate(code.splitlines(), 1):
        key = line.strip()
        if key and seen.setdefault(key, n) != n:
            out.append((n, seen[key], key[:60] + ("..." if len(key) > 60 else "")))
    return out


def windows(code, size, chars):
    lines = [x.rstrip() for x in code.splitlines()]
    for i in range(len(lines) - size + 1):
        block = "\n".join(lines[i:i + size]).strip()
        if len(block) >= chars:
            yield i + 1, block


def brute_blocks(code, size, chars):
    seen, out = {}, []
    for n, block in windows(code, size, chars):
        if seen.setdefault(block, n) != n:
            out.append((n, seen[block], block[:80] + ("..." if len(block) > 80 else "")))
    return out


def brute_cross(items, size, chars):
    """items: (path, code) of one batch, in order."""
    by_path = {}
    for path, code in items:
        by_path[path] = code
    seen, out = {}, []
    for path, code in by_path.items():
        for n, block in windows(code, size, chars):
            first = seen.setdefault(block, (path, n))
            if first[0] != path:
                out.append((path, n, *first, block[:80] + ("..." if len(block) > 80 else "")))
    return out


def texts(seed, n=40):
    rng = random.Random(seed)
    pool = ["alpha beta  ", "  gamma", "", "}", "delta ", "x" * 70, "long line of text that is repeated", "\tz"]
    seps = ["\n", "\n", "\n", "\r\n", " "]
    return ["".join(rng.choice(pool) + rng.choice(seps) for _ in range(rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 5), (3, 16)])
def test_within_file(spark, seed, parts):
    codes = texts(seed)
    df = spark.createDataFrame([("b", i, f"p{i}", c) for i, c in enumerate(codes)],
                               "batch_id string, file_ord bigint, path string, code string").repartition(parts)
    lines, blocks = set(), set()
    for i, c in enumerate(codes):
        lines |= {(i, *x) for x in brute_lines(c)}
        blocks |= {(i, *x) for x in brute_blocks(c, 3, 12)}
    assert lines and blocks

    def rows(found):
        out = [(r.file_ord, r.line, r.original_line, r.snippet) for r in found.collect()]
        assert len(out) == len(set(out))
        return set(out)

    assert rows(duplicates.duplicate_lines(df)) == lines
    assert rows(duplicates.near_duplicate_blocks(df, 3, 12)) == blocks
    both = duplicates.within_file_duplicates(df, 3, 12)
    assert rows(both.where("type = 'ip_duplication'")) == lines
    assert rows(both.where("type = 'ip_near_duplicate'")) == blocks


@pytest.mark.parametrize("seed,parts,unique,salts,bits", [(4, 1, True, 32, None), (5, 7, True, 1, None), (6, 3, False, 4, None), (6, 3, False, 4, 27), (4, 2, True, 2, 5)])
def test_across_files(spark, seed, parts, unique, salts, bits):
    rng = random.Random(seed)
    hot = "hot boilerplate block\nwith three lines\nin every third file\n"
    items = [(rng.choice("xyz"), f"p{i}" if unique else f"p{rng.randint(0, 25)}", (hot if rng.random() < 0.4 else "") + c)
             for i, c in enumerate(texts(seed, 60))]
    df = spark.createDataFrame([(b, i, p, c) for i, (b, p, c) in enumerate(items)],
                               "batch_id string, file_ord bigint, path string, code string").repartition(parts)
    want = set()
    for batch in "xyz":
        want |= {(batch, *x) for x in brute_cross([(p, c) for b, p, c in items if b == batch], 3, 12)}
    got = [(r.batch_id, r.path, r.line, r.original_file, r.original_line, r.snippet)
           for r in duplicates.cross_file_duplicates(df, 3, 12, unique_paths=unique, salts=salts, two_pass=bits is not None, bits=bits or 27).collect()]
    assert want and len(got) == len(set(got))
    assert set(got) == want


def test_short_files(files):
    f = files("", "a", "a\nb", "x" * 300)
    assert duplicates.near_duplicate_blocks(f).count() == 0
    assert duplicates.cross_file_duplicates(f).count() == 0


def test_two_passes_move_shared_blocks_only(spark):
    shared = "".join(f"line {i} of the part that all files have\n" for i in range(6))
    rows = [("b", i, f"p{i}", "".join(f"own line {i} {j} of this file\n" for j in range(100)) + shared) for i in range(50)]
    df = spark.createDataFrame(rows, "batch_id string, file_ord bigint, path string, code string")
    every, some = duplicates.file_blocks(df, 4, 10), duplicates.file_blocks(df, 4, 10, shared_only=True)
    assert every.count() == 50 * 103 and some.count() == 50 * 3
    kept = some.collect()
    keys = {r.k for r in kept}
    assert sorted(map(repr, kept)) == sorted(repr(r) for r in every.collect() if r.k in keys)
    table = duplicates.shared_block_bits(df, 4, 10, bits=20)
    assert table.nbytes == (1 << 20) // 8 and int(np.unpackbits(table).sum()) == 3
    sized = df.withColumn("w", F.lit(4)).withColumn("c", F.lit(10))
    assert duplicates.cross_file_duplicates(sized, F.col("w"), F.col("c"), two_pass=True).count() == 49 * 3
    alone = df.limit(1)
    assert duplicates.cross_file_duplicates(alone, 4, 10, two_pass=True).count() == 0
