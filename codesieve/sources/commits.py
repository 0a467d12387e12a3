"""Commits of stored tables: one small file per epoch, put in place whole or not at all."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer put its commit in place first."""


def files_of(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def commit(spark: SparkSession, path: str, body: dict) -> None:
    """Write ``path/commits/<epoch>.json``; an existing one of the same epoch stays, and ``Conflict`` is raised."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder, files = files_of(spark, f"{path}/commits")
    files.mkdirs(folder)
    draft, _ = files_of(spark, f"{path}/commits/.{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray(json.dumps(body).encode()))
    out.close()
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{body['epoch']}.json")
    contexts = jvm.org.apache.hadoop.fs.FileContext
    context = contexts.getFileContext(final.toUri(), conf) if final.toUri().getScheme() else contexts.getFileContext(conf)
    none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    try:
        context.rename(draft, final, none)
    except Exception as e:
        files.delete(draft, False)
        if files.exists(final):
            raise Conflict(str(body["epoch"])) from e
        raise
