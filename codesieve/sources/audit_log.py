"""The stored audit log: appends that number and chain their rows, and readers of what is committed.

``path/log/epoch=<n>-<id>`` holds the JSON lines of one append, ``path/commits/<n>.json`` its commit: the folder, and for
each lane the position and hash of its last row.  An append reads the newest commit, chains its rows onto the lanes'
heads, writes its own folder and then puts the next commit in place, which fails if another append came first;
then it starts again from the new head.  Folders without a commit are not part of the log.

A lane is one chain.  Lanes are chained in parallel, rows are dealt to them by their audit id; with one lane the log is one
chain.  A row's place is (epoch, lane, position in its lane), and its ``seq`` a number that grows with the epoch, so no append sorts or
counts the log.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from codesieve import schemas
from codesieve.functions import text
from codesieve.operators.audit import canonical_entry
from codesieve.sources.commits import Conflict, commit, files_of

#: Chains of a new log.
LANES = 16
#: Rows of one append that ``seq`` has room for.
EPOCH_ROWS = 1 << 40
#: Fields that an append adds to an entry; they are not part of what is signed.
PLACED = ["hash", "prev_hash", "seq", "lane", "pos"]
_COMMIT = "epoch bigint, folder string, lanes int, rows bigint, heads array<struct<lane:int,pos:bigint,hash:string>>"


@dataclass(frozen=True)
class Head:
    """The end of a log: its newest epoch, its number of lanes, and (position, hash) of each lane's last row."""

    epoch: int
    lanes: int
    last: dict[int, tuple[int, str | None]]


def is_log(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds a stored log with a commit."""
    place, files = files_of(spark, f"{path}/commits")
    return files.exists(place)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """One row for each append: epoch, folder, lanes, rows, heads."""
    if not is_log(spark, path):
        return spark.createDataFrame([], _COMMIT)
    return spark.read.schema(_COMMIT).json(f"{path}/commits")


def head(spark: SparkSession, path: str, lanes: int = LANES) -> Head:
    """The end of the log; that of a new one has ``lanes`` empty lanes."""
    last = commits(spark, path).orderBy(F.desc("epoch")).first()
    if last is None:
        return Head(-1, lanes, {})
    return Head(last.epoch, last.lanes, {h.lane: (h.pos, h.hash) for h in last.heads})


def _chained(at: Head, key: bytes):
    """Tasks' step over rows (lane, entry), lane after lane: the stored lines."""

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lane, pos, prev = None, -1, None
        for pdf in batches:
            lines = []
            for own, text_ in zip(pdf.lane, pdf.entry, strict=True):
                if own != lane:
                    lane = own
                    pos, prev = at.last.get(int(lane), (-1, None))
                    first = pos + 1
                pos += 1
                entry = json.loads(text_)
                digest = hmac.new(key, canonical_entry(entry, prev), hashlib.sha256).hexdigest() if key else None
                seq = (at.epoch + 1) * EPOCH_ROWS + (pos - first) * at.lanes + int(lane)
                signed = {"hash": digest, "prev_hash": prev} if key else {}
                lines.append(json.dumps({**entry, **signed, "seq": seq, "lane": int(lane), "pos": pos}))
                prev = digest
            yield pd.DataFrame({"value": lines})

    return step


def stamped(rows: DataFrame) -> DataFrame:
    """Rows with ``timestamp`` and ``audit_id`` where they have none.

    Both are fixed once per append, so a task that runs again gives the same rows: the id is derived from a random number of
    the append and the request id, which is unique in it.
    """
    now = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")
    seed = F.concat(F.lit(uuid.uuid4().hex), F.coalesce("request_id", F.lit(""))) if "request_id" in rows.columns else F.lit(uuid.uuid4().hex)
    made = F.regexp_replace(F.md5(seed.cast("binary")), "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5")
    given = F.coalesce(F.col("audit_id"), made) if "audit_id" in rows.columns else made
    return rows.withColumn("audit_id", given).withColumn("timestamp", F.coalesce("timestamp", F.lit(now)) if "timestamp" in rows.columns else F.lit(now))


def append(rows: DataFrame, path: str, key: bytes = b"", lanes: int = LANES, tries: int = 5) -> Head:
    """Append entries (one for each row; null fields are left out) and return the log's new end.

    With a ``key`` every row is signed together with the hash of the row before it in its lane, also across appends.  The
    lanes of an existing log stay.  Appends of several writers do not mix: one of them starts again, at most ``tries`` times.
    """
    spark = rows.sparkSession
    ready = stamped(rows)
    for _ in range(tries):
        at = head(spark, path, lanes)
        entry = F.to_json(F.struct(*[F.col(f"`{c}`") for c in ready.columns if c not in PLACED]))
        dealt = ready.select(F.pmod(F.xxhash64("audit_id"), F.lit(at.lanes)).cast("int").alias("lane"), "audit_id", entry.alias("entry"))
        ordered = dealt.repartition(at.lanes, "lane").sortWithinPartitions("lane", "audit_id", "entry").select("lane", "entry")
        folder = f"epoch={at.epoch + 1}-{uuid.uuid4().hex}"
        ordered.mapInPandas(_chained(at, key), "value string").write.text(f"{path}/log/{folder}")
        ends = spark.read.schema("lane int, pos bigint, hash string").json(f"{path}/log/{folder}").groupBy("lane").agg(
            F.max("pos").alias("pos"), F.max_by("hash", "pos").alias("hash"), F.count("*").alias("n")).collect()  # a row for each lane
        last = at.last | {r.lane: (r.pos, r.hash) for r in ends}
        body = {"epoch": at.epoch + 1, "folder": folder, "lanes": at.lanes, "rows": sum(r.n for r in ends),
                "heads": [{"lane": lane, "pos": pos, "hash": hash_} for lane, (pos, hash_) in sorted(last.items())]}
        try:
            commit(spark, path, body)
            return Head(at.epoch + 1, at.lanes, last)
        except Conflict:
            place, files = files_of(spark, f"{path}/log/{folder}")
            files.delete(place, True)  # this append's own folder
    raise Conflict(f"{path}: other appends came first {tries} times")


def _folders(spark: SparkSession, path: str) -> list[str]:
    return [f"{path}/log/{r.folder}" for r in commits(spark, path).select("folder").collect()]  # a name for each append


def read(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """All committed rows in the log's schema, with ``seq``; a malformed line fails the strict read and is skipped otherwise."""
    folders = _folders(spark, path)
    if not folders:
        return spark.createDataFrame([], schemas.AUDIT)
    reader = spark.read.schema(schemas.AUDIT).option("mode", "FAILFAST" if strict else "DROPMALFORMED")
    return reader.json(folders)


@F.pandas_udf(StringType())
def _canonical_line(lines: pd.Series) -> pd.Series:
    """What the hash of a stored line signs; null for a line that is no entry."""
    out = []
    for line in lines:
        try:
            entry = json.loads(line)
            prev = entry.get("prev_hash")
            out.append(canonical_entry({k: v for k, v in entry.items() if k not in PLACED}, prev).decode("ascii"))
        except (ValueError, AttributeError):
            out.append(None)
    return pd.Series(out, dtype=object)


def _ok(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False))


def verify(spark: SparkSession, path: str, key: bytes) -> DataFrame:
    """(lane, pos, seq, hash_ok, link_ok) of every stored row, over all appends.

    ``hash_ok``: the row is as it was signed; ``link_ok``: it names the hash of the row before it in its lane.  Rows are checked in
    parallel, links by an equality join on the position.  A lane's last row that a commit names and that is gone has a
    row with both false.
    """
    folders = _folders(spark, path)
    kind = "lane int, pos bigint, seq bigint, hash string, prev_hash string"
    lines = spark.read.text(folders) if folders else spark.createDataFrame([], "value string")
    rows = lines.select("value", F.from_json("value", kind).alias("p")).select("value", "p.*")
    checked = rows.select("lane", "pos", "seq", "hash", "prev_hash", _ok(text.hmac_sha256(key, _canonical_line("value")) == F.col("hash")).alias("hash_ok"))
    prior = rows.select("lane", (F.col("pos") + 1).alias("pos"), F.col("hash").alias("before"))
    linked = checked.join(prior, ["lane", "pos"], "left").select("lane", "pos", "seq", "hash_ok", F.col("prev_hash").eqNullSafe(F.col("before")).alias("link_ok"))
    heads = commits(spark, path).orderBy(F.desc("epoch")).limit(1).select(F.inline("heads")).select("lane", "pos")
    gone = heads.join(rows.select("lane", "pos"), ["lane", "pos"], "left_anti")
    return linked.unionByName(gone.select("lane", "pos", F.lit(None).cast("bigint").alias("seq"), F.lit(False).alias("hash_ok"), F.lit(False).alias("link_ok")))
