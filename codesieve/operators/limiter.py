"""Sliding-window admission per client (T3, W9), exact, over a whole log of requests."""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from codesieve import fixed_values as fv

#: Requests of a client that the stream sorts in memory at a time.
HELD_ROWS = 100_000
LIMIT = fv.RATE_RPS * fv.RATE_WINDOW_SECONDS + fv.RATE_BURST


def admit(times, window: float, limit: int, state: deque | None = None) -> list[bool]:
    """Admit a request when fewer than ``limit`` admitted ones lie in the window before it."""
    taken = deque() if state is None else state
    out = []
    for now in times:
        while taken and now - taken[0] >= window:
            taken.popleft()
        ok = len(taken) < limit
        if ok:
            taken.append(now)
        out.append(ok)
    return out


def _micros():
    return F.unix_micros(F.col("ts").cast("timestamp"))


def window_counts(requests: DataFrame, window: int = fv.RATE_WINDOW_SECONDS) -> DataFrame:
    """Requests of the client in the window ending at each request (an upper bound of admissions).

    A window over a whole client would be one task.  Rows are grouped by client and time bucket of
    one window length, and each row ends in the bucket after its own.  All rows of the bucket before
    are in the window when a bucket begins, so the count is their number, less the ends and plus the
    requests so far: running sums, linear in the rows of a bucket.  The window is open at its
    far end: a request exactly ``window`` seconds old does not count.  Rows without a time are left out.
    """
    width = window * 1_000_000
    stamped = requests.withColumn("_us", _micros()).where("_us is not null").withColumn("_bucket", F.floor(F.col("_us") / width))
    ended = F.col("_step") < 0
    both = stamped.withColumn("_step", F.explode(F.array(F.lit(1), F.lit(-1)))).withColumns({
        "_us": F.when(ended, F.col("_us") + width).otherwise(F.col("_us")),
        "_bucket": F.when(ended, F.col("_bucket") + 1).otherwise(F.col("_bucket"))})
    bucket = Window.partitionBy("client", "_bucket")
    so_far = bucket.orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    counted = both.withColumn("in_window", F.sum("_step").over(so_far) + F.count_if(ended).over(bucket)).where(~ended)
    return counted.drop("_us", "_bucket", "_step")


def admissions(requests: DataFrame, window: int = fv.RATE_WINDOW_SECONDS, limit: int = LIMIT) -> DataFrame:
    """``requests`` (client, ts, id, ...) with ``admitted``.

    Admission depends on earlier admissions, so it is sequential, but only where a client is at
    its limit.  Requests are counted per client and time bucket of one window length.  When a
    bucket and the one before hold at most ``limit`` requests, all requests of the bucket are
    admitted for sure and need no Python.  The rest forms runs of contended buckets; a run starts
    from the sure bucket before it, whose admissions are known.  Runs are independent, stream
    through their task in time order, and keep at most ``limit`` times in memory.
    """
    if limit <= 0:
        return requests.withColumn("admitted", F.lit(False))
    width = window * 1_000_000
    stamped = requests.withColumn("_us", _micros()).withColumn("_b", F.floor(F.col("_us") / width))
    per_bucket = stamped.groupBy("client", "_b").agg(F.count("*").alias("n"))
    in_order = Window.partitionBy("client").orderBy("_b")
    before = F.when(F.lag("_b").over(in_order) == F.col("_b") - 1, F.lag("n").over(in_order)).otherwise(0)
    marked = per_bucket.withColumn("sure", F.col("n") + before <= limit)
    # a sure bucket opens a run; contended buckets belong to the last opened one
    runs = marked.withColumn("run", F.last(F.when(F.col("sure"), F.col("_b")), ignorenulls=True).over(in_order))
    runs = runs.withColumn("run", F.coalesce("run", F.lit(-(2**62))))
    per_run = Window.partitionBy("client", "run").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = runs.withColumn("contended", F.bool_or(~F.col("sure")).over(per_run)).select("client", "_b", "run", "sure", "contended")
    tagged = stamped.join(runs, ["client", "_b"])
    certain = tagged.where("sure").withColumn("admitted", F.lit(True)).drop("_us", "_b", "run", "sure", "contended")
    replay = tagged.where("contended").repartition("client", "run").sortWithinPartitions("client", "run", "_us", "id")
    names = requests.columns

    def run_batches(batches):
        at, taken = None, None
        for pdf in batches:
            flags = []
            for client, run, us in zip(pdf.client, pdf.run, pdf._us):
                if (client, run) != at:
                    at, taken = (client, run), deque()
                flags.extend(admit([us], width, limit, taken))
            pdf["admitted"] = flags
            yield pdf.loc[~pdf.sure, [*names, "admitted"]]

    schema = requests.withColumn("admitted", F.lit(True)).schema
    decided = replay.mapInPandas(run_batches, schema)
    return certain.unionByName(decided)


class Admissions(StatefulProcessor):
    """The streaming form: state of a client are the admitted times of the last window, at most ``limit`` numbers.

    Rows of a micro-batch are taken in time order.  Up to ``held_rows`` of them are sorted in memory; more are dealt
    to time buckets of one window in the state store and taken from there bucket by bucket, so no client is held whole.  The
    state is dropped when the client was silent for a window.
    """

    def __init__(self, window: int, limit: int, held_rows: int = HELD_ROWS):
        self.width, self.limit, self.held_rows = window * 1_000_000, limit, held_rows

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.taken = handle.getValueState("taken", "times array<bigint>")
        self.held = handle.getMapState("held", "bucket bigint, part bigint", "requests binary")

    def _answers(self, key, requests: np.ndarray, taken: deque) -> pd.DataFrame:
        requests = requests[np.lexsort((requests[:, 1], requests[:, 0]))]
        flags = admit(requests[:, 0].tolist(), self.width, self.limit, taken)
        return pd.DataFrame({"client": key[0], "id": requests[:, 1], "us": requests[:, 0], "admitted": flags})

    def handleInputRows(self, key, rows, timerValues):
        waiting, n, last, parts = [], 0, 0, {}
        taken = deque(self.taken.get()[0] if self.taken.exists() else ())
        for pdf in rows:
            own = pdf[["us", "id"]].to_numpy(np.int64)
            waiting.append(own)
            n, last = n + len(own), max(last, int(own[:, 0].max()))
            if n > self.held_rows:
                self._put(np.concatenate(waiting), parts)
                waiting, n = [], 0
        if parts and waiting:
            self._put(np.concatenate(waiting), parts)
        elif waiting:
            yield self._answers(key, np.concatenate(waiting), taken)
        for bucket in sorted(parts):
            names = [(bucket, part) for part in range(parts[bucket])]
            requests = np.concatenate([np.frombuffer(self.held.getValue(name)[0], np.int64).reshape(-1, 2) for name in names])
            for name in names:
                self.held.removeKey(name)
            yield self._answers(key, requests, taken)
        self.taken.update((list(taken),))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer((max(last, *taken) if taken else last) // 1000 + self.width // 1000 + 1)

    def _put(self, requests: np.ndarray, parts: dict[int, int]) -> None:
        buckets = requests[:, 0] // self.width
        for bucket in np.unique(buckets).tolist():
            part = parts.get(bucket, 0)
            self.held.updateValue((bucket, part), (requests[buckets == bucket].tobytes(),))
            parts[bucket] = part + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.taken.clear()
        yield pd.DataFrame({"client": pd.Series([], dtype="int64"), "id": pd.Series([], dtype="int64"), "us": pd.Series([], dtype="int64"), "admitted": pd.Series([], dtype=bool)})

    def close(self) -> None:
        pass
