"""Files and their findings in generations: a later generation replaces all rows of a (batch, path) at once.

``path/gen=<n>-<id>/<table>`` holds the rows that a generation brings, ``path/commits/<n>.json`` names its folder.  Readers see
committed generations only, so texts, backups and findings of a rewrite become visible together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from codesieve.sources.commits import commit, files_of

_COMMIT = "epoch bigint, folder string"
KEYS = ["batch_id", "path"]


def folders(spark: SparkSession, path: str) -> list[str]:
    """Folders of the committed generations, oldest first; one name for each."""
    place, files = files_of(spark, f"{path}/commits")
    if not files.exists(place):
        return []
    return [f"{path}/{r.folder}" for r in spark.read.schema(_COMMIT).json(f"{path}/commits").orderBy("epoch").collect()]


def add(path: str, files: DataFrame, **tables: DataFrame) -> None:
    """Add a generation: ``files`` (their texts) and further tables, all with batch_id and path.

    Tables are written one after the other, so later ones may be computed from what is written before; a table given as a
    function gets the files as written.
    """
    spark = files.sparkSession
    epoch = len(folders(spark, path))
    folder = f"gen={epoch}-{uuid.uuid4().hex}"
    files.write.parquet(f"{path}/{folder}/files")
    stored = spark.read.schema(files.schema).parquet(f"{path}/{folder}/files")
    for name, table in tables.items():
        (table(stored) if callable(table) else table).write.parquet(f"{path}/{folder}/{name}")
    commit(spark, path, {"epoch": epoch, "folder": folder})


def current(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Rows of a table whose (batch, path) no later generation brings; only keys of the later ones meet the older rows."""
    out, later = None, None
    for folder in reversed(folders(spark, path)):
        rows = spark.read.parquet(f"{folder}/{table}")
        kept = rows if later is None else rows.join(later, KEYS, "left_anti")
        out = kept if out is None else kept.unionByName(out, allowMissingColumns=True)
        own = spark.read.parquet(f"{folder}/files").select(*KEYS).distinct()
        later = own if later is None else later.unionByName(own).distinct()
    if out is None:
        raise FileNotFoundError(f"{path} has no generation")
    return out
