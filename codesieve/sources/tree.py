"""Listing and reading of folder trees inside tasks, for all file systems that pyarrow opens."""

from __future__ import annotations

import os.path

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

_BATCH = 5_000


def _open(root: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(root if "://" in root else "file://" + os.path.abspath(root))
    return system, path.rstrip("/")


def _children(system: fs.FileSystem, folder: str, skipped: frozenset[str]) -> tuple[list[str], list[fs.FileInfo]]:
    entries = system.get_file_info(fs.FileSelector(folder))
    folders = [e.path for e in entries if e.type == fs.FileType.Directory and e.base_name not in skipped]
    return folders, [e for e in entries if e.type == fs.FileType.File]


def list_files(spark: SparkSession, root: str, extensions: list[str], exclude_dirs: list[str], max_bytes: int | None) -> DataFrame:
    """(location, size) of all wanted files.

    The driver only opens folders until there is work for all tasks; the tasks walk what lies below.
    """
    known, skipped = frozenset(extensions), frozenset(exclude_dirs)
    system, start = _open(root)
    wanted = 4 * spark.sparkContext.defaultParallelism
    deep, flat = [start], []
    while deep and len(deep) + len(flat) < wanted:
        folder = deep.pop(0)
        flat.append(folder)
        deep.extend(_children(system, folder, skipped)[0])
    work = [(f, True) for f in deep] + [(f, False) for f in flat]

    def keep(info: fs.FileInfo) -> bool:
        ext = os.path.splitext(info.base_name)[1].lower()
        return (not known or ext in known) and (max_bytes is None or info.size <= max_bytes)

    def walk(batches):
        here, _ = _open(root)
        for pdf in batches:
            for folder, below in zip(pdf.folder, pdf.below):
                stack, found = [folder], []
                while stack:
                    folders, infos = _children(here, stack.pop(), skipped)
                    found.extend((i.path, i.size) for i in infos if keep(i))
                    if below:
                        stack.extend(folders)
                    if len(found) >= _BATCH:
                        yield pd.DataFrame(found, columns=["location", "size"])
                        found = []
                yield pd.DataFrame(found, columns=["location", "size"])

    folders = spark.createDataFrame(work, "folder string, below boolean").repartition(min(len(work), wanted))
    return folders.mapInPandas(walk, "location string, size bigint")


def read_contents(files: DataFrame, root: str, batch_bytes: int = 16_000_000) -> DataFrame:
    """(path, content) with paths relative to ``root``; locations are spread evenly before reading."""
    _, start = _open(root)

    def read(batches):
        system, _ = _open(root)
        for pdf in batches:
            rows, size = [], 0
            for location in pdf.location:
                with system.open_input_stream(location) as stream:
                    content = stream.read()
                rows.append((location[len(start) + 1:], content))
                size += len(content)
                if size >= batch_bytes:
                    yield pd.DataFrame(rows, columns=["path", "content"])
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=["path", "content"])

    return files.repartition("location").mapInPandas(read, "path string, content binary")
