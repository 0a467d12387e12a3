"""N-gram Jaccard join by universe partition and pigeonhole.

The 64-bit hashes of all word shingles form a universe that each size band cuts into ``m`` equal ranges
(segments).  Sets r and s (|r| <= |s|) with Jaccard similarity >= 0.8 differ in at most
``(|r| + |s|) / 9 <= |r| / 4`` elements, and each of them spoils one segment.  A segment is indexed by its
subset (one key, it counts 1) or by its subset and all subsets without one element (it counts 2,
as it also matches across one difference).  The segments that r emits count ``|r| / 4 + 1 + slack``
in all, so the two share a key.  Segments are emitted from the first on, so the smaller set's
segments are among those of the larger one; a set emits in its own band and, if partners can be there,
in the band below.  ``allocation`` picks for each band how many segments of each kind and which slack cost least.

Keys that cannot tell sets apart (empty subsets, and keys of more than ``DENSE`` components that are not linked)
are dropped.  A pair loses at most what *both* members lose, so only pairs of two
members that lost more than the slack are searched anew: by their rarest shingles (prefix filter, exact).
A candidate is first held against parity sketches, one bit per element: bits in which two sketches differ are a
lower bound of the difference of the sets, so no link is lost.  The rest is verified by exact intersection of the hash sets.

Copies collapse to one class before.  Pairs of one component are not expanded: each key first links
all its classes to the least one, and only keys that still hold several components give pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codesieve.llm.common import ascii_lower, components, mix, text_bytes, text_steps, word_bounds, word_hashes, written

WIDTH = 5
#: A key with more components than this is replaced by the exact search on rare shingles.
DENSE = 32
#: Rows of keys that are sent to all tasks instead of moving the texts to them, at most (32 bytes each).
BROADCAST_ROWS = 1_000_000
_RATIO = 1.5
#: 64-bit numbers of the folded sketch.
_FOLD = 8
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def shingle_sets(batch: pa.RecordBatch, width: int = WIDTH):
    """For each row of a batch: sorted distinct 64-bit hashes of its word shingles (empty without words)."""
    data, offsets = text_bytes(batch.column(batch.schema.get_field_index("text")))
    data = ascii_lower(data)
    starts, ends, first = word_bounds(data, offsets, ~_SPACE)
    words = word_hashes(data, starts, ends)
    factors = mix(np.arange(11, 11 + width, dtype=np.uint64)) | np.uint64(1)
    full = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        full += words[k:k + len(full)] * factors[k]
    full = mix(full)
    for i in range(batch.num_rows):
        lo, n = int(first[i]), int(first[i + 1] - first[i])
        if n >= width:
            yield np.unique(full[lo:lo + n - width + 1])
        elif n:
            yield mix((words[lo:lo + n] * factors[:n]).sum(dtype=np.uint64, keepdims=True) + np.uint64(n))
        else:
            yield np.zeros(0, np.uint64)


def set_keys(items: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums that name a set."""
    two = mix(np.stack([items ^ np.uint64(0xA5A5A5A5A5A5A5A5), items + np.uint64(0x1234567890ABCDEF)])).sum(axis=1, dtype=np.uint64)
    a, b = two.view(np.int64).tolist()
    return a, b


def band_of(n: int) -> int:
    """Bands are [1.5^b, 1.5^(b+1)), rounded up."""
    b = int(math.log(n, _RATIO))
    while band_low(b + 1) <= n:
        b += 1
    while b and band_low(b) > n:
        b -= 1
    return b


def _remembered(f):
    """Keep results by their number.  (``lru_cache`` would be pickled by name, and workers may not have the package.)"""
    known: dict = {}

    def g(b: int):
        if b not in known:
            known[b] = f(b)
        return known[b]

    return g


@_remembered
def band_low(b: int) -> int:
    return math.ceil(_RATIO**b)


@_remembered
def allocation(b: int) -> tuple[int, int, int]:
    """(segments, of them with deletions, slack) of a band, at the least expected number of index rows.

    For a set of middle size: the keys emitted, plus the rows of the exact search times the
    chance that more than the slack is lost to empty segments (taken as Poisson).
    """
    low, high = band_low(b), band_low(b + 1) - 1
    size = (low + high) / 2
    best = None
    for deletions in range(0, min(8, high // 8 + 1) + 1):
        for slack in range(0, high // 8 + 12):
            need = high // 4 + 1 + slack
            m = max(need - deletions, deletions)
            length = size / m
            emitted = max(deletions, size / 4 + 1 + slack - deletions)
            lost = (emitted - deletions) * math.exp(-length) + 2 * deletions * (1 + length) * math.exp(-length)
            term = total = math.exp(-lost)
            for i in range(1, slack + 1):
                term *= lost / i
                total += term
            cost = emitted + deletions * length + max(0.0, 1 - total) * 4 * size
            if best is None or cost < best[0]:
                best = (cost, m, deletions, slack)
    return best[1:]


def emitted_segments(n: int, b: int) -> int:
    """How many of a band's segments a set of n elements emits, from the first on."""
    m, deletions, slack = allocation(b)
    return min(m, max(deletions, n // 4 + 1 + slack - deletions))


def bands(n: int) -> list[int]:
    """The bands in which a set of n elements takes part; sets of 3 and fewer have no partner but copies."""
    if n < 4:
        return []
    own = band_of(n)
    return [own] if math.ceil(0.8 * n) >= band_low(own) or own == 0 else [own, own - 1]


def signatures(items: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of one set in one band, and for each the segment it stands for; segments whose keys can be
    empty are left out."""
    m, deletions, _ = allocation(b)
    count = emitted_segments(len(items), b)
    place = ((items >> np.uint64(11)).astype(np.float64) * (m / 2.0**53)).astype(np.int64)
    bounds = np.searchsorted(place, np.arange(count + 1))
    codes = mix(items + np.uint64(0x632BE59BD9B4E019))
    sums = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(codes, out=sums[1:])
    total = sums[bounds[1:]] - sums[bounds[:-1]]
    sizes = np.diff(bounds)
    seg = np.arange(count)
    whole = np.where(seg < deletions, sizes > 1, sizes > 0)
    keys, of = [total[whole]], [seg[whole]]
    for j in np.flatnonzero(whole[:deletions]).tolist():
        keys.append(total[j] - codes[bounds[j]:bounds[j + 1]])
        of.append(np.full(sizes[j], j))
    keys, of = np.concatenate(keys), np.concatenate(of)
    tag = mix(of.astype(np.uint64) + np.uint64((b + 1) * 0x9E3779B97F4A7C15 % 2**64))
    return mix(keys ^ tag), of


def sketch(items: np.ndarray) -> bytes:
    """Parity of the elements that fall on each bit; about as many bits as elements, a power of two from 512 on."""
    bits = 64 * _FOLD
    while bits < len(items):
        bits *= 2
    place = (mix(items ^ np.uint64(0x3C3C3C3C3C3C3C3C)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(place, minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes) -> list[int]:
    """A sketch folded to 512 bits, as numbers."""
    x = np.frombuffer(bits, np.int64)
    return np.bitwise_xor.reduce(x.reshape(-1, _FOLD), axis=0).tolist()


def least_difference(a: bytes, b: bytes) -> int:
    """Lower bound of the symmetric difference of two sets from their sketches; the longer one is folded."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2:]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2:]
    return int(np.bitwise_count(x ^ y).sum())


def _named(width):
    def step(batches):
        for batch in batches:
            for part in text_steps(batch):
                rows = [(len(s), *set_keys(s), sketch(s) if len(s) else None) for s in shingle_sets(part, width)]
                n, k, k2, bits = zip(*rows, strict=True)
                fold = [folded(b) if b else None for b in bits]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(k, pa.int64()), pa.array(k2, pa.int64()), pa.array(bits, pa.binary()), pa.array(fold, pa.list_(pa.int64()))],
                                                 names=["id", "h", "n", "k", "k2", "bits", "fold"])

    return step


def _possible(batches):
    """Pairs (x, y, sizes, sketches) that can link as far as sizes and sketches tell."""
    for batch in batches:
        nx, ny = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        keep = [9 * least_difference(a, b) <= m + n for a, b, m, n in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), nx.tolist(), ny.tolist(), strict=True)]
        yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])


def short_key(b: int) -> int:
    """The key under which sets meet that lost more than the slack of band b to empty segments."""
    return int(mix(np.array([b + 1], np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).view(np.int64)[0])


def lost_weight(items: np.ndarray, b: int, dense: set[int] | None = None) -> int:
    """What a set loses of its count in a band: empty or dense segments, twice where deletions are indexed."""
    keys, of = signatures(items, b)
    count, deletions = emitted_segments(len(items), b), allocation(b)[1]
    useful = np.zeros(count, bool)
    useful[of] = True
    if dense:
        useful[of[np.isin(keys.view(np.int64), np.fromiter(dense, np.int64))]] = False
    gone = ~useful
    return int(gone.sum() + gone[:deletions].sum())


def _keyed(width):
    def step(batches):
        seen: dict = {}
        for batch in batches:
            for part in text_steps(batch):
                out, own = [], []
                for items in shingle_sets(part, width):
                    if len(items) < 4 or (key := set_keys(items)) in seen:
                        continue  # no partner but copies, or a copy whose keys are there already
                    if len(seen) >= 200_000:
                        seen.clear()
                    seen[key] = None
                    for b in bands(len(items)):
                        keys = signatures(items, b)[0].view(np.int64)
                        if lost_weight(items, b) > allocation(b)[2]:
                            keys = np.append(keys, short_key(b))
                        out.append(keys)
                        own.append(np.full(len(keys), key[0], np.int64))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.concatenate(own))], names=["sig", "k"])

    return step


def _still_short(batches):
    """Bands in which a set with dense keys lost more than the slack."""
    for batch in batches:
        out = []
        for k, items, dense in zip(*(batch.column(i) for i in range(3)), strict=True):
            items, dense = np.array(items.values, dtype=np.int64).view(np.uint64), set(dense.as_py())
            out += [(k.as_py(), b) for b in bands(len(items)) if lost_weight(items, b, dense) > allocation(b)[2]]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in ((0, pa.int64()), (1, pa.int32()))], names=["k", "band"])


def _listed(width):
    """Columns of the rows but the text (the last), and the set."""

    def step(batches):
        for batch in batches:
            for part in text_steps(batch):
                sets = list(shingle_sets(part, width))
                ends = np.zeros(len(sets) + 1, np.int32)
                np.cumsum([len(s) for s in sets], out=ends[1:])
                flat = np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["k", "node", "items"])

    return step


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """Links (x, y, a, b) of pairs (x, y) of class keys, a and b being the numbers of the two classes; classes
    whose 64-bit keys clash are tried one by one."""
    a = classes.selectExpr("k as x", "n as nx", "bits as bx")
    b = classes.selectExpr("k as y", "n as ny", "bits as by")
    sized = pairs.join(a, "x").join(b, "y").where("100 * least(nx, ny) >= 80 * greatest(nx, ny)").select("x", "y", "nx", "ny", "bx", "by")
    likely = written(sized.mapInArrow(_possible, "x bigint, y bigint").distinct())
    sets = _sets(likely.selectExpr("x as k").unionByName(likely.selectExpr("y as k")).distinct(), classes, texts, width)
    left = sets.selectExpr("k as x", "node as a", "items as left_items")
    right = sets.selectExpr("k as y", "node as b", "items as right_items")
    common = F.size(F.array_intersect("left_items", "right_items"))
    both = F.size("left_items") + F.size("right_items")
    return likely.join(left, "x").join(right, "y").where(100 * common >= 80 * (both - common)).select("x", "y", "a", "b")


def _sets(keys: DataFrame, classes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(k, node, items) of the classes with some keys, from the text of the class's least row (id, hash of the text):
    an id may stand on rows with different texts."""
    members = written(classes.join(keys, "k", "left_semi").selectExpr("k", "node", "rep as id", "h"))
    chosen = F.broadcast(members) if members.count() <= BROADCAST_ROWS else members
    rows = texts.withColumn("h", F.xxhash64("text")).join(chosen, ["id", "h"]).dropDuplicates(["id", "h"])
    return written(rows.select("k", "node", "text").mapInArrow(_listed(width), "k bigint, node bigint, items array<bigint>"))


def _cross(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Distinct pairs of classes that share a key, are not yet in one component, and may link by their sizes
    and folded sketches: all of it is a condition of the join, so no other pair is made."""
    named = rows.join(classes.select("k", "n", *[F.col("fold")[i].alias(f"f{i}") for i in range(_FOLD)]), "k")
    left = named.select("sig", *[F.col(c).alias(f"x_{c}") for c in named.columns if c != "sig"])
    right = named.select("sig", *[F.col(c).alias(f"y_{c}") for c in named.columns if c != "sig"])
    apart = " + ".join(f"bit_count(x_f{i} ^ y_f{i})" for i in range(_FOLD))
    may = F.expr(f"x_k < y_k AND x_c <> y_c AND 100 * least(x_n, y_n) >= 80 * greatest(x_n, y_n) AND 9 * ({apart}) <= x_n + y_n")
    return left.join(right, (left["sig"] == right["sig"]) & may).selectExpr("x_k as x", "y_k as y").distinct()


def _with_components(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows (k, ...) with the component of the class, which is the class itself where it has no link."""
    return rows.join(found.selectExpr("node as k", "component as c"), "k", "left").withColumn("c", F.coalesce("c", "k"))


def _rare_pairs(short: DataFrame, sets: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Candidate pairs among the sets that were short in one band: equal shingles among the rarest.

    Sets of n elements with similarity 0.8 and more share at least ``ceil(0.8 n)``, so in any common
    order one of the first ``n - ceil(0.8 n) + 1`` is shared.
    """
    items = short.join(sets, "k").select("k", "node", "band", F.size("items").alias("n"), F.explode("items").alias("item"))
    often = items.groupBy("band", "item").agg(F.count("*").alias("df"))
    order = Window.partitionBy("band", "k", "node").orderBy("df", "item")
    ranked = items.join(often.where("df > 1"), ["band", "item"], "left").withColumn("df", F.coalesce("df", F.lit(1)))
    front = ranked.withColumn("place", F.row_number().over(order)).where("place <= n - ceil(0.8 * n) + 1 and df > 1")
    return _cross(_with_components(front.select(F.xxhash64("band", "item").alias("sig"), "k"), found), classes)


def _classified(docs: DataFrame, id_col: str, text_col: str, width: int) -> tuple[DataFrame, DataFrame]:
    """The rows (id, hash of the text h, n, k, k2) and the classes (k, k2, rep, h, component, head): (rep, h) is the
    class's least row, ``component`` the least id of all linked classes, ``head`` marks the class that has its least row."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    named = written(texts.select("id", F.xxhash64("text").alias("h"), "text").mapInArrow(_named(width), "id bigint, h bigint, n bigint, k bigint, k2 bigint, bits binary, fold array<bigint>"))
    classes = named.where("n > 0 and id is not null").groupBy("k", "k2").agg(F.min(F.struct("id", "h")).alias("least"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("fold").alias("fold"))
    # Classes may have the same least id, so each gets a number; being written, it stays.
    classes = written(classes.select("k", "k2", F.col("least.id").alias("rep"), F.col("least.h").alias("h"), "n", "bits", "fold", F.monotonically_increasing_id().alias("node")))

    # Keys shared by two classes and more; each links its classes to the least of them.
    keyed = texts.where("id is not null").mapInArrow(_keyed(width), "sig bigint, k bigint")
    of_key = Window.partitionBy("sig")
    marked = keyed.withColumn("lo", F.min("k").over(of_key)).withColumn("hi", F.max("k").over(of_key))
    shared = written(marked.where("lo <> hi").select("sig", "k", "lo"))

    is_short = F.col("sig").isin([short_key(b) for b in range(64)])
    stars = written(shared.where(~is_short).where("k <> lo").selectExpr("lo as x", "k as y").distinct())
    first = written(_verified(stars, classes, texts, width))
    by_key = written(components(first.selectExpr("x as a", "y as b")))

    # Keys that still hold several components: few components give pairs, many are dense.
    open_keys = _with_components(shared.where(~is_short), by_key)
    many = open_keys.groupBy("sig", "c").agg(F.lit(1).alias("one")).groupBy("sig").agg(F.sum("one").alias("many")).where("many > 1")
    open_keys = written(open_keys.join(many, "sig").select("sig", "k", "c", "many"))
    cross = _cross(open_keys.where(F.col("many") <= DENSE).drop("many"), classes).join(stars, ["x", "y"], "left_anti")

    # Classes that lost more than the slack of a band to empty or dense keys: pairs by their rarest shingles.
    dense = written(open_keys.where(F.col("many") > DENSE).groupBy("k").agg(F.collect_set("sig").alias("dense")))
    for_empty = shared.where(is_short).select("k", F.array_position(F.array(*[F.lit(short_key(b)) for b in range(64)]), F.col("sig")).cast("int").alias("p")).selectExpr("k", "p - 1 as band")
    for_empty = written(for_empty.distinct())
    sets = _sets(dense.select("k").unionByName(for_empty.select("k")).distinct(), classes, texts, width)
    short = sets.select("k", "items").join(dense, "k").mapInArrow(_still_short, "k bigint, band int")
    short = written(short.unionAll(for_empty).distinct())
    rest = written(cross).unionByName(written(_rare_pairs(short, sets, classes, by_key))).distinct()
    links = first.unionByName(_verified(rest, classes, texts, width)).selectExpr("a", "b")
    linked = classes.drop("n", "bits", "fold").join(components(links).withColumnRenamed("component", "c"), "node", "left")
    linked = written(linked.withColumn("c", F.coalesce("c", "node")))
    least = written(linked.groupBy("c").agg(F.count("*").alias("many"), F.min(F.struct("rep", "h")).alias("least")).where("many > 1").select("c", "least"))
    own = F.struct("rep", "h")
    whole = linked.join(least, "c", "left").withColumn("least", F.coalesce("least", own))
    return named.select("id", "h", "n", "k", "k2"), whole.select("k", "k2", "rep", "h", F.col("least.rep").alias("component"), (F.col("least") == own).alias("head"))


def similar_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, n_shingles, component) of every row of ``docs``: components of texts linked at 0.8 and more.

    ``docs`` needs an integer id and a text; further columns are ignored.  A null or wordless text has an
    empty set and is its own component; rows with the same set are one class; rows with a null id
    are returned with their set size and a null component, and never name one.  An id may stand on rows with different texts: each row
    gets the component of its own text, and two components without a link may then bear the same id.  Two different sets with the same 128-bit
    name would be taken for one (chance below 1e-18 at 1e10 texts).
    """
    named, classes = _classified(docs, id_col, text_col, width)
    whole = named.drop("h").join(classes.select("k", "k2", "component"), ["k", "k2"], "left")
    return whole.select("id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("id")).when(F.col("id").isNotNull(), F.col("component")).alias("component"))


def least_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """(id, h) of the rows to keep: of every component the row of least id (and hash of the text, ``xxhash64``), and
    all rows whose text has no words.  Each (id, h) comes once; rows with a null id are left out."""
    named, classes = _classified(docs, id_col, text_col, width)
    return classes.where("head").select(F.col("rep").alias("id"), "h").unionByName(named.where("n = 0 and id is not null").select("id", "h").distinct())
