"""The corpus pipeline: five stages, each over all that the one before has kept.

Language ID drops documents without a known language, the Jaccard join keeps one document of each group,
decontamination drops documents with benchmark text, the secret scan blanks secrets out, and BPE
encodes what is left and decodes it again.  A stage's result is written as Parquet in the
shared folder and read as the next one's documents.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import codesieve
from codesieve.llm import bpe, jaccard, langid, postings, secrets
from codesieve.llm.common import table, written
from codesieve.llm.queries import TOKENIZER

cloudpickle.register_pickle_by_value(codesieve)  # the workers may not have this folder on their path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a language; ``lang`` becomes the predicted one.

    The tagger learns from rows with a given language; null and empty texts and texts without letters go.
    """
    found = langid.predict(docs, langid.fit(docs), keep=COLUMNS)
    return found.where(F.col("lang_pred") != langid.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group of linked texts.

    Rows with a null id stay, as do texts without words; of rows with the same id and text one stays.  An id on rows with
    different texts is as many documents.
    """
    least = jaccard.least_rows(docs).toDF("doc_id", "h")
    rows = docs.select(*COLUMNS, F.xxhash64(F.col("text").cast("string")).alias("h"))
    kept = rows.join(least, ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id", "h"])
    return kept.unionByName(rows.where("doc_id is null")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of which one word in twenty lies in benchmark text.

    Each row is judged by its own text: one with a null id goes as any other, and one that shares its id with a
    contaminated text stays if its own is clean.
    """
    rows = docs.select(*COLUMNS, F.xxhash64("doc_id", F.col("text").cast("string")).alias("row"))
    found = postings.contamination(postings.build_index(rows, id_col="row"), table(spark, sf_dir, "benchmark"))
    bad = found.where("contaminated").select(F.col("id").alias("row")).distinct()
    return rows.join(bad, "row", "left_anti").select(*COLUMNS)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put ``[secret]`` in the place of every secret; overlapping ones are blanked as one.  ``n_chars`` follows."""
    found = secrets.scan(docs, keep=COLUMNS)
    pieces = F.expr("aggregate(found, struct('' as done, 0 as at), (a, s) -> struct("
                    "concat(a.done, CASE WHEN s.start >= a.at THEN concat(substring(text, a.at + 1, s.start - a.at), '[secret]') ELSE '' END) as done,"
                    " greatest(a.at, s.stop) as at), a -> concat(a.done, substring(text, a.at + 1)))")
    blanked = F.when(F.size("found") > 0, pieces).otherwise(F.col("text"))
    return found.withColumn("text", blanked).withColumn("n_chars", F.when(F.size("found") > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode every text and decode it: token count and digests of the ids and of the decoded text."""
    return bpe.digests(docs, TOKENIZER).withColumnRenamed("id", "doc_id")


STAGES = [("language_id", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secret_scan", secret_scan), ("bpe", encode)]

#: Language ID, the duplicate groups and BPE have no SQL form: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
