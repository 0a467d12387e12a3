"""Helpers shared by the operators: shared folder, written tables, byte-level words, hashing, components."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Text bytes that one Python step holds as arrays at a time; longer texts are a step of their own.
STEP_BYTES = 4 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a new local one is set only where a local master names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def written(df: DataFrame, **options) -> DataFrame:
    """Write a frame to the shared folder and read it back: lost executors then cost no recomputation."""
    path = f"{shared_folder(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def text_sample(rows: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """At most ``n`` different texts (column ``text``), in each group of ``by`` if given: those of the least hashes.

    Only hashes are ranked; the at most ``n`` chosen ones of a group are then sent to the texts.
    """
    by = by or []
    named = rows.withColumn("h", F.xxhash64("text"))
    keys = named.select(*by, "h").distinct()
    if by:
        ranked = keys.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy("h")))
        keys = ranked.where(F.col("r") <= n).drop("r")
    else:
        keys = keys.orderBy("h").limit(n)
    return named.join(F.broadcast(keys), [*by, "h"]).dropDuplicates([*by, "h"])


def windows_sql(text: str, most: int, pieces: int = 4) -> str:
    """A text of at most ``most`` characters as it is; of a longer one as many in all, in windows from its start to its end."""
    each = max(1, most // pieces - 1)
    place = f"cast(1 + cast(i as bigint) * (length({text}) - {each}) div {pieces - 1} as int)"
    return (f"CASE WHEN length({text}) <= {most} THEN {text} ELSE"
            f" array_join(transform(sequence(0, {pieces - 1}), i -> substring({text}, {place}, {each})), ' ') END")


def text_steps(batch: pa.RecordBatch, column: str = "text", limit: int = STEP_BYTES, rows: int = 1 << 14):
    """Cut a batch into slices of at most ``limit`` text bytes and ``rows`` rows; a longer text is a slice of its own."""
    col = batch.column(batch.schema.get_field_index(column))
    ends = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < batch.num_rows:
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, min(lo + rows, int(np.searchsorted(ends, base + limit, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and the n + 1 offsets of its rows; null is empty."""
    col = col.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(col.buffers()[1], dtype=np.int64, count=len(col) + 1 + col.offset)[col.offset:]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of word bytes that stay inside a row, and for each row the index
    of its first word (n + 1 values)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = is_word[data]
    first = np.empty(len(data), bool)
    first[0] = True
    first[1:] = ~inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    first[edges] = True
    starts = np.flatnonzero(inside & first)
    last = np.empty(len(data), bool)
    last[-1] = True
    last[:-1] = ~inside[1:]
    last[edges[edges > 0] - 1] = True
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range, from one prefix sum of a polynomial over random byte codes."""
    codes = mix(np.arange(1, 257, dtype=np.uint64))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(codes[data] * _powers(_BASE, len(data)), out=sums[1:])
    back = _powers(pow(_BASE, -1, 2**64), len(data) + 1)
    return mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def ascii_lower(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; all other bytes stay."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    return fold[data]


def _forest(batches):
    """Replace the links of each batch by a spanning forest: fewer rows, the same components."""
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = list(range(len(nodes)))

        def find(x):
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for x, y in zip(at[: len(a)].tolist(), at[len(a):].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                root[max(x, y)] = min(x, y)
        own = np.array([find(x) for x in range(len(nodes))], dtype=np.int64)
        keep = own != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[own[keep]])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node with a link; the component is its smallest node.

    Alternating large-star and small-star rounds on the ``a``, ``b`` link table, where ``a`` is the larger node; each
    half of a round is a written table, so that no plan holds more than one of them, minima are partial aggregates, and only a
    change flag comes to the driver.
    """
    edges = links.selectExpr("cast(a as bigint) a", "cast(b as bigint) b").where("a is not null and b is not null and a <> b")
    edges = written(edges.mapInArrow(_forest, "a bigint, b bigint"))  # a forest's links lead to smaller nodes, and so do those of the rounds

    def digest(df):
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        return row.n, row.s

    before = None
    while True:
        both = edges.unionAll(edges.selectExpr("b as a", "a as b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).selectExpr("a as b", "least(a, m) as m")
        down = written(edges.join(low, "b").selectExpr("a", "m as b").distinct())
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").where("b <> m").selectExpr("b as a", "m as b").unionAll(least.selectExpr("a", "m as b"))
        edges = written(small.distinct())
        now = digest(edges)
        if now == before:
            break
        before = now
    return edges.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").unionAll(
        edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
