"""Readers (S1-S10).  All schemas are fixed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codesieve import fixed_values as fv
from codesieve import schemas
from codesieve.functions import text
from codesieve.sources import audit_log, tree, tree_source


def read_tree(spark: SparkSession, root: str, extensions: list[str] | None = None, exclude_dirs: list[str] | None = None,
              max_bytes: int | None = None, batch_id: str = "tree", listing: str = "walk") -> DataFrame:
    """Source files below ``root``: (batch_id, path, code).  ``extensions=[]`` keeps all files.

    Excluded folders are not entered; extensions and sizes are checked before content is read.
    Spark's own listing skips names that start with ``_`` or ``.``, such as ``__init__.py``, so by
    default tasks list the folders and read the files.  ``listing="source"`` uses the data source ``code_tree``, which plans
    partitions of even bytes from one listing; ``listing="spark"`` the built-in binary source for trees without such names.
    """
    known = list(fv.LANGUAGE_BY_EXTENSION) if extensions is None else [e.lower() for e in extensions]
    skipped = fv.EXCLUDED_DIRS if exclude_dirs is None else exclude_dirs
    if listing == "source":
        found = tree_source.read_tree(spark, root, known, list(skipped), max_bytes)
        return found.select(F.lit(batch_id).alias("batch_id"), "path", "code")
    if listing == "walk":
        contents = tree.read_contents(tree.list_files(spark, root, known, skipped, max_bytes), root)
        return contents.select(F.lit(batch_id).alias("batch_id"), "path", text.utf8_text(F.col("content")).alias("code"))
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if known:
        def both(e: str) -> str:
            return "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e.lstrip("."))

        reader = reader.option("pathGlobFilter", "*.{" + ",".join(both(e) for e in known) + "}")
    files = reader.load(root)
    location = F.col("_metadata.file_path")
    relative = text.relative_path(F.url_decode(F.replace(location, F.lit("+"), F.lit("%2B"))), root)
    for name in skipped:
        files = files.where(~F.contains(F.concat(F.lit("/"), relative), F.lit(f"/{name}/")))
    if max_bytes is not None:
        files = files.where(F.col("_metadata.file_size") <= max_bytes)
    out = files.select(F.lit(batch_id).alias("batch_id"), relative.alias("path"), text.utf8_text(F.col("content")).alias("code"))
    return out.where(text.extension(F.col("path")).isin(known)) if known else out


def number_files(files: DataFrame) -> DataFrame:
    """Add ``file_ord`` to files that have none: a stable number from the path.

    Positions only decide which copy counts as the first one; a hash of the path gives every file
    its place without a global sort.
    """
    return files.withColumn("file_ord", F.xxhash64("batch_id", "path"))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Batch requests, one JSON object per line."""
    return spark.read.schema(schemas.BATCH_REQUEST).json(path)


def request_files(requests: DataFrame) -> DataFrame:
    """Files of requests with their position."""
    rows = requests.select("batch_id", F.posexplode("files").alias("pos", "f"))
    return rows.select("batch_id", F.col("pos").cast("bigint").alias("file_ord"), F.coalesce("f.path", F.lit("unknown")).alias("path"),
                       F.coalesce("f.code", F.lit("")).alias("code"), F.col("f.patch").alias("patch"), F.col("f.language").alias("language"))


def request_batches(requests: DataFrame) -> DataFrame:
    """Scan options of requests, without texts and keys."""
    return requests.withColumn("has_key", F.coalesce(F.col("ai_api_key") != "", F.lit(False))).drop(
        "files", "repo_license_texts", "ai_api_key")


def request_license_texts(requests: DataFrame) -> DataFrame:
    rows = requests.select("batch_id", F.posexplode("repo_license_texts").alias("pos", "t"))
    return rows.select("batch_id", F.col("pos").cast("bigint").alias("file_ord"), F.col("t.path").alias("path"), F.col("t.content").alias("code"))


def read_rulepacks(spark: SparkSession, path: str, sector: str | None = None) -> DataFrame:
    """Rule rows, partitioned by pack; an unknown sector gives no rows."""
    from codesieve.rules import RULE_SCHEMA

    rules = spark.read.schema(RULE_SCHEMA).parquet(path)
    return rules if sector is None else rules.where(F.col("pack") == sector)


def list_rulepacks(rules: DataFrame) -> DataFrame:
    """Sorted pack names."""
    return rules.select("pack").distinct().orderBy("pack")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """Configuration files as rows (scope, repo, config_path, body): JSON lines."""
    return spark.read.schema("scope string, repo string, config_path string, body string").json(path)


def with_config(rows: DataFrame, configs: DataFrame, paths: list[str] | None = None) -> DataFrame:
    """Add ``config`` to rows with a ``repo``: the first existing file of the repository laid over the organisation's.

    A repository without a file has the organisation's configuration; without that all fields are null.
    """
    order = F.array(*[F.lit(p) for p in (paths or fv.CONFIG_PATHS)])
    parsed = configs.withColumn("config", F.from_json("body", schemas.CONFIG))
    own = parsed.where("scope = 'repo'").withColumn("place", F.array_position(order, F.col("config_path"))).where("place > 0")
    w = Window.partitionBy("repo").orderBy("place")  # at most one row per candidate path
    first = own.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("repo", F.col("config").alias("_own"))
    org = parsed.where("scope = 'org'").groupBy("scope").agg(F.first("config", ignorenulls=True).alias("_org"))
    both = rows.join(first, "repo", "left").withColumn("scope", F.lit("org")).join(F.broadcast(org), "scope", "left")  # at most one row
    return both.withColumn("config", overlay(F.col("_org"), F.col("_own"), first.schema["_own"].dataType)).drop("scope", "_org", "_own")


def effective_config(configs: DataFrame, paths: list[str] | None = None, repos: DataFrame | None = None) -> DataFrame:
    """(repo, config) of every repository of ``repos``, or of those with a file of their own.

    Fields of the repository replace the organisation's; objects (``policy``, ``coding_standards_builtin``) are merged by key.
    """
    if repos is None:
        known = F.array(*[F.lit(p) for p in (paths or fv.CONFIG_PATHS)])
        repos = configs.where((F.col("scope") == "repo") & F.array_contains(known, F.col("config_path")))
    return with_config(repos.select("repo").distinct(), configs, paths).select("repo", "config")


def overlay(base: Column, over: Column, schema) -> Column:
    """Field-wise overlay of two configuration structs; maps are merged and the right side wins."""
    fields = []
    for f in schema.fields:
        left, right = base[f.name], over[f.name]
        if f.dataType.typeName() == "map":
            merged = overlay_objects(left, right) if f.name == "coding_standards_builtin" else overlay_maps(left, right)
            value = F.when(left.isNull(), right).when(right.isNull(), left).otherwise(merged)
        else:
            value = F.coalesce(right, left)
        fields.append(value.alias(f.name))
    return F.struct(*fields)


def overlay_maps(left: Column, right: Column) -> Column:
    """Union of keys; the right value wins, also when it is null."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def overlay_objects(left: Column, right: Column) -> Column:
    """The same for maps of JSON texts; objects on both sides are merged by key once more."""
    def both(l: Column, r: Column) -> Column:
        kind = "map<string,boolean>"
        return F.to_json(overlay_maps(F.from_json(l, kind), F.from_json(r, kind)))

    return F.map_zip_with(left, right, lambda k, l, r: F.when(l.startswith("{") & r.startswith("{"), both(l, r)).when(
        F.map_contains_key(right, k), r).otherwise(l))


def read_audit(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Rows of an audit log, a stored one (``audit_log``) or plain JSON lines; a malformed line fails the strict read and is skipped otherwise."""
    if audit_log.is_log(spark, path):
        return audit_log.read(spark, path, strict)
    reader = spark.read.schema(schemas.AUDIT)
    return reader.option("mode", "FAILFAST" if strict else "DROPMALFORMED").json(path)


def read_review_comments(comments: DataFrame, marker: str = fv.REVIEW_MARKER) -> DataFrame:
    from codesieve.operators.changes import existing_comments

    return existing_comments(comments, marker)
