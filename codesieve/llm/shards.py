"""Sharding by minimax contiguous partition.

Rows with equal texts are one atomic group; the groups stand in the order of their text's hash.  The smallest
capacity for which the ordered groups fit into the shards is found by binary search with a greedy check,
and the shards are cut there.  No list of all groups is ever on the driver: the groups are first
summed into ranges of the order; as a cut into whole ranges is one valid cut, it bounds the capacity from
above, and the mean and the largest group bound it from below.  Between these bounds each cut
can move through a few ranges only.  Those are split finer, and so on, until the ranges in question are
single groups; all other ranges stay whole.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import written

#: Bits of the order key that one refinement resolves.
STEP_BITS = 10
KEY_BITS = 60
#: Rows that one numbering task orders, about.
SLOT_ROWS = 200_000


Block = tuple[int, int, int, int]  # first key, bits of its width, bytes, groups; blocks in order cover all groups


def _fill(blocks: list[Block], ends: list[int], capacity: int, shards: int, split: bool) -> list[int]:
    """Greedy fill: the running totals at which the shards end.  With ``split``, blocks of several groups can
    be cut anywhere (a bound from below on any capacity); without, nowhere (a bound from above)."""
    out, done = [], 0
    for _ in range(shards):
        reach = done + capacity
        at = bisect_right(ends, reach)
        whole = ends[at - 1] if at else 0
        done = reach if split and at < len(ends) and blocks[at][3] > 1 else max(done, whole)
        out.append(done)
    return out


def _smallest(blocks: list[Block], ends: list[int], shards: int, low: int, split: bool) -> int:
    """Least capacity from ``low`` on that holds everything."""
    high = ends[-1]
    while low < high:
        mid = (low + high) // 2
        if _fill(blocks, ends, mid, shards, split)[-1] < ends[-1]:
            low = mid + 1
        else:
            high = mid
    return low


def cut_points(groups: DataFrame, shards: int) -> tuple[int, list[int]]:
    """Smallest capacity and, for every shard but the first, the order key at which it begins.

    ``groups`` has ``key`` (a number from 0 below 2^60, unique) and ``bytes``.
    """
    total = groups.agg(F.sum("bytes").alias("b"), F.max("bytes").alias("m"), F.count("*").alias("n")).first()
    if not total.n:
        return 0, [1 << KEY_BITS] * (shards - 1)
    blocks: list[Block] = [(0, KEY_BITS, int(total.b), total.n)]
    active, low = {0}, max(int(total.m), -(-int(total.b) // shards))
    while True:
        for bits in sorted({blocks[i][1] for i in active}):
            chosen = [i for i in active if blocks[i][1] == bits]
            finer = max(0, bits - STEP_BITS)
            inside = groups.where(F.shiftright("key", bits).isin([blocks[i][0] >> bits for i in chosen])) if bits < KEY_BITS else groups
            rows = inside.groupBy(F.shiftright("key", finer).alias("p")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")).collect()
            gone = {blocks[i][0] for i in chosen}
            blocks = [b for b in blocks if b[0] not in gone or b[1] != bits] + [(r.p << finer, finer, int(r.b), r.n) for r in rows]
        blocks.sort()
        ends = list(accumulate(b[2] for b in blocks))
        low = _smallest(blocks, ends, shards, low, True)
        high = _smallest(blocks, ends, shards, low, False)
        if low == high:
            break
        active = set()
        for first, last in zip(_fill(blocks, ends, low, shards, False), _fill(blocks, ends, high, shards, True), strict=True):
            active |= {i for i in range(bisect_right(ends, first), min(bisect_right(ends, last) + 1, len(blocks))) if blocks[i][3] > 1}
        if not active:
            break
    begins = [bisect_right(ends, done) for done in _fill(blocks, ends, high, shards, False)[:-1]]
    return high, [blocks[i][0] if i < len(blocks) else 1 << KEY_BITS for i in begins]


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) of every row: shards of nearly equal bytes, equal texts together.

    The size is the text's UTF-8 bytes plus 8; a null text has none and is a group of its own beside the
    empty one.  ``slot`` numbers a shard's rows without a gap from 0.  Repeated rows and ids keep a
    slot each; shards may stay empty.  Groups are told apart by a 60-bit hash, so two texts of one hash would
    be kept together.
    """
    text = F.col(text_col).cast("string")
    base = written(docs.select(F.col(id_col).cast("bigint").alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("size"),
                               F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("bigint").alias("text_crc32"),
                               F.shiftrightunsigned(F.xxhash64(text, text.isNull()), 64 - KEY_BITS).alias("key")))
    groups = written(base.groupBy("key").agg(F.sum("size").cast("bigint").alias("bytes")))
    _, begins = cut_points(groups, shards)
    parts = int(base.count() // (SLOT_ROWS * shards)) + 1
    number = sum([(F.col("key") >= b).cast("int") for b in begins], F.lit(0))
    placed = base.withColumn("shard", number).withColumn("part", F.pmod(F.xxhash64("id", "key"), F.lit(parts)))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    offsets = counts.select("shard", "part", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    inside = F.row_number().over(Window.partitionBy("shard", "part").orderBy("key", "id"))
    return placed.withColumn("at", inside).join(offsets, ["shard", "part"]).select("id", "size", "text_crc32", "shard", (F.col("offset") + F.col("at") - 1).alias("slot"))
