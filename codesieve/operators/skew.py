"""Joins and ordered computations that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32
ORDER_BUCKET = 65_536


def salt_of(column: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(salts)).cast("int")


def salted_join(left: DataFrame, dim: DataFrame, keys: list[str], spread: str, how: str = "left", salts: int = SALTS) -> DataFrame:
    """Join a narrow dimension with one row per key.

    The dimension is repeated once per salt, the left rows of one key are spread over the salts by
    the column ``spread``, so a key with a third of all rows lands in ``salts`` tasks, not in one.
    A dimension below the broadcast threshold is broadcast by the planner, which checks its size.
    """
    repeated = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("_salt", salt_of(spread, salts)).join(repeated, [*keys, "_salt"], how).drop("_salt")


def order_cuts(df: DataFrame, order: str, parts: int | None = None) -> list[int]:
    """Values of an integer column that part its rows into about equal shares: approximate quantiles, one row to the driver."""
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if parts < 2:
        return []
    shares = F.array(*[F.lit(i / parts) for i in range(1, parts)])
    found = df.agg(F.percentile_approx(order, shares, 20 * parts).alias("q")).first().q
    return sorted(set(found or []))


def _place(order: str, cuts: list[int]) -> Column:
    """Number of cuts at or below a value: a search through halves, so a row compares with few of them."""
    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(order) < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    return search(0, len(cuts)).cast("bigint")


def ordered_running(df: DataFrame, keys: list[str], order: str, amount: Column, out: str, descending: bool = False,
                    bucket: int | None = ORDER_BUCKET, parts: int | None = None) -> DataFrame:
    """Running total of ``amount`` in the order of an integer column (unique within its key).

    A window over a whole key would be one task.  Here rows are totalled per bucket of the order
    column first, the bucket totals (few rows) get the offsets, and the row-level window only
    spans one bucket.  Buckets are ``bucket`` wide; with None they are ``parts`` ranges between quantiles of the column
    (as many as shuffle partitions by default), which also serves positions that are hashes.
    """
    place = F.floor(F.col(order) / bucket) if bucket else _place(order, order_cuts(df, order, parts))
    numbered = df.withColumn("_bucket", place).withColumn("_amount", amount.cast("bigint"))
    totals = numbered.groupBy(*keys, "_bucket").agg(F.sum("_amount").alias("_total"))
    by_bucket = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    before = Window.partitionBy(*keys).orderBy(by_bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_bucket", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    by_row = F.col(order).desc() if descending else F.col(order).asc()
    inside = Window.partitionBy(*keys, "_bucket").orderBy(by_row).rowsBetween(Window.unboundedPreceding, 0)
    joined = numbered.join(offsets, [*keys, "_bucket"])
    return joined.withColumn(out, F.col("_offset") + F.sum("_amount").over(inside)).drop("_bucket", "_amount", "_offset")


def ordered_number(df: DataFrame, keys: list[str], order: str, out: str = "rn", bucket: int | None = ORDER_BUCKET) -> DataFrame:
    """1-based position inside each key, in the order of an integer column; for ``bucket`` see ``ordered_running``."""
    return ordered_running(df, keys, order, F.lit(1), out, bucket=bucket)


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int | None) -> DataFrame:
    """First ``n`` rows per key; all rows for None.

    Up to 1,000, the planner limits each input partition to ``n`` rows per key before the shuffle, so a hot key
    never arrives whole in one task.
    """
    if n is None:
        return df
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("_rn") <= n).drop("_rn")


def spread(files: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Repartition a table that was read in fewer partitions than there are cores.

    Text is never shuffled at scale: a large table has more input splits than cores and is
    returned as it is.  Use it on a table as read, before any other operation.
    """
    wanted = partitions or files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(wanted, key) if files.rdd.getNumPartitions() < wanted else files
