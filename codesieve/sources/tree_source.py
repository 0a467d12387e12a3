"""A data source for source trees: ``spark.read.format("code_tree").load(root)`` gives (path, code, size).

The listing (names and sizes) plans the read: files are packed into partitions of about equal bytes, so a flat folder
is read by all tasks, and contents are read in tasks only and handed over as Arrow batches.
"""

from __future__ import annotations

import json
import os.path
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from codesieve import fixed_values as fv
from codesieve.sources import tree

#: Bytes and files of a partition at most (one larger file is a partition of its own), and bytes of an Arrow batch.
PARTITION_BYTES, PARTITION_FILES, BATCH_BYTES = 64 << 20, 5_000, 16 << 20


def packed(sizes: list[int], parts: int, most_bytes: int = PARTITION_BYTES, most_files: int = PARTITION_FILES) -> list[list[int]]:
    """Places of files in partitions: at least ``parts`` if there are so many files, and none above the limits.

    Largest first, each into the partition with the fewest bytes that has room for one more file.
    """
    import heapq

    total = sum(sizes)
    n = min(len(sizes), max(parts, -(-total // most_bytes), -(-len(sizes) // most_files)))
    out: list[list[int]] = [[] for _ in range(n)]
    heap = [(0, 0, p) for p in range(n)]
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        held, files, p = heapq.heappop(heap)
        out[p].append(i)
        if files + 1 < most_files:
            heapq.heappush(heap, (held + sizes[i], files + 1, p))
    return [sorted(p) for p in out if p]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.extensions = frozenset(json.loads(options.get("extensions", json.dumps(list(fv.LANGUAGE_BY_EXTENSION)))))
        self.skipped = frozenset(json.loads(options.get("excludedirs", json.dumps(list(fv.EXCLUDED_DIRS)))))
        self.max_bytes = int(options["maxbytes"]) if "maxbytes" in options else None
        self.parts = int(options.get("partitions", 1))

    def listing(self) -> Iterator[tuple[str, int]]:
        """(location, size) of the wanted files; excluded folders are not entered."""
        system, start = tree._open(self.root)
        stack = [start]
        while stack:
            folders, infos = tree._children(system, stack.pop(), self.skipped)
            stack.extend(folders)
            for info in infos:
                known = not self.extensions or os.path.splitext(info.base_name)[1].lower() in self.extensions
                if known and (self.max_bytes is None or info.size <= self.max_bytes):
                    yield info.path, info.size

    def partitions(self) -> list[InputPartition]:
        files = sorted(self.listing())
        return [InputPartition([files[i][0] for i in part]) for part in packed([size for _, size in files], self.parts)] or [InputPartition([])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, start = tree._open(self.root)
        rows: list[tuple[str, str, int]] = []
        held = 0

        def batch() -> pa.RecordBatch:
            paths, codes, sizes = zip(*rows, strict=True) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(codes, pa.string()), pa.array(sizes, pa.int64())], names=["path", "code", "size"])

        for location in partition.value:
            with system.open_input_stream(location) as stream:
                content = stream.read()
            rows.append((location[len(start) + 1:], content.decode("utf-8", "ignore"), len(content)))
            held += len(content)
            if held >= BATCH_BYTES:
                yield batch()
                rows, held = [], 0
        yield batch()


class TreeSource(DataSource):
    """Options: ``extensions`` and ``excludeDirs`` (JSON lists; ``[]`` keeps all), ``maxBytes``, ``partitions`` (at least so many)."""

    @classmethod
    def name(cls) -> str:
        return "code_tree"

    def schema(self) -> str:
        return "path string, code string, size bigint"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def read_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, exclude_dirs: list[str] | None = None, max_bytes: int | None = None) -> DataFrame:
    """The source files below ``root`` with at least two partitions for each core, if there are so many files."""
    spark.dataSource.register(TreeSource)
    reader = spark.read.format("code_tree").option("partitions", 2 * spark.sparkContext.defaultParallelism)
    for name, value in (("extensions", extensions), ("excludeDirs", exclude_dirs)):
        if value is not None:
            reader = reader.option(name, json.dumps([v.lower() for v in value] if name == "extensions" else value))
    return (reader if max_bytes is None else reader.option("maxBytes", max_bytes)).load(root)
