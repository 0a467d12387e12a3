"""Registered queries of the operators: each reads its whole table and derives its columns from the operator's rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codesieve.llm import bpe, collocations, jaccard, langid, nearvec, packing, personal, postings, quality, render, secrets, shards, spelling
from codesieve.llm.common import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def _digest(text) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def _remainder(n: int) -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(-1))


def _counts(spans: str, kinds: list[str]) -> list[Column]:
    return [F.expr(f"cast(size(filter({spans}, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in kinds]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = postings.build_index(table(spark, sf_dir, "documents"))
    found = postings.contamination(index, table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        _digest(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.extract(table(spark, sf_dir, "pages")).select(F.col("id").alias("page_id"), "text", F.length("text").cast("bigint").alias("n_chars"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(table(spark, sf_dir, "documents")).toDF("doc_id", "n_shingles", "component_id")


def _span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = personal.spans(docs, personal.fit(docs))
    place = F.array(*[F.lit(k) for k in personal.KINDS])
    ordered = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(F.array_position(place, s["kind"]).alias("p"), s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))))
    return found.select(F.col("id").alias("doc_id"), *_counts("base", personal.KINDS), _digest(_span_text(F.col("base"))).alias("base_sha256"), _span_text(ordered).alias("spans"))


def op5_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearvec.near_vectors(table(spark, sf_dir, "embeddings")).toDF("vec_id", "n_links", "component_id", "kept")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    space = quality.train(docs, labels.where(_remainder(5) != 0))
    held = F.col("id").cast("string").cast("binary")
    return quality.score(docs, space).select(F.col("id").alias("doc_id"), F.coalesce(F.crc32(held) % 5 == 0, F.lit(False)).alias("held_out"), "score",
                                             (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard(table(spark, sf_dir, "documents"), 24)
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = [r.kind for r in secrets.RULES if r.base]
    found = secrets.scan(table(spark, sf_dir, "documents"))
    return found.select(F.col("doc_id").cast("bigint").alias("doc_id"), *_counts("found", base), _digest(secrets.joined("found", base)).alias("base_sha256"), secrets.joined("found").alias("spans"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tagger = langid.fit(docs.where((_remainder(4) != 2) & F.col("doc_id").isNotNull()))
    return langid.predict(docs, tagger).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER).withColumnRenamed("id", "doc_id")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), TOKENIZER)
    return pieces.select(F.col("id").alias("doc_id"), "start", (F.octet_length("ids") / 4).cast("bigint").alias("length"), F.crc32("ids").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_html_extraction, op3_jaccard_join, op4_personal_data, op5_near_vectors, op6_quality,
                            op7_sharding, op8_secret_scan, op9_language, op10_bpe, op11_packing, op12_spelling_variants, op13_collocations)
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_decontamination": rf"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, s, s + n - 1), ' ') AS phrase
  FROM (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, greatest(2, len(w) - 11))) AS s FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM docs, lengths WHERE len(w) >= n),
found AS (SELECT p.doc_id, p.s, p.n, x.item_id FROM places p JOIN windows x ON x.n = p.n AND x.phrase = array_to_string(list_slice(p.w, p.s, p.s + p.n - 1), ' ')),
hits AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS place FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op12_spelling_variants": r"""
WITH tab AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]{7,}')) AS w FROM documents) GROUP BY ALL),
hexed AS (SELECT *, hex(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w) AS x FROM runs),
sums AS (SELECT w, n, xor(list_reduce([4294967295] || list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM hexed, tab),
slipped AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, CAST(h % len(w) AS INT)) || substr(w, CAST(h % len(w) AS INT) + 2) ELSE w END AS word, n FROM sums),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM slipped WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, CAST(unnest(range(1, len(word) + 1)) AS INT) AS i FROM words)),
one AS (SELECT DISTINCT a.word AS a, a.n AS an, b.word AS b, b.n AS bn FROM cut a JOIN words b ON a.rest = b.word),
near AS (SELECT a AS word, b AS near, bn AS near_n FROM one UNION ALL SELECT b, a, an FROM one
  UNION ALL SELECT a.word, b.word, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word),
ranked AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM near),
forms AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * w.n THEN near END AS form, CASE WHEN near_n >= 10 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN ranked x ON x.word = w.word AND x.r = 1),
way AS (WITH RECURSIVE steps AS (SELECT word, word AS at FROM forms UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NOT NULL)
  SELECT s.word, s.at AS root FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM forms f JOIN way USING (word)""",
    "op13_collocations": r"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS p FROM docs)),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pieces GROUP BY lang),
grams AS (SELECT lang, k, array_to_string(list_slice(w, s, s + k - 1), ' ') AS phrase
  FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM pieces, (VALUES (1), (2), (3), (4)) v(k) WHERE len(w) >= k)),
freq AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS w FROM freq WHERE k >= 2),
cuts AS (SELECT lang, phrase, a, w, k, unnest(range(1, k)) AS c FROM cand),
scored AS (SELECT x.lang, x.phrase, x.a, c, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * a) // (CAST(l.f AS HUGEINT) + r.f) AS BIGINT) AS score
  FROM cuts x JOIN freq l ON l.lang = x.lang AND l.phrase = array_to_string(list_slice(w, 1, c), ' ')
  JOIN freq r ON r.lang = x.lang AND r.phrase = array_to_string(list_slice(w, c + 1, x.k), ' ')),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
parts AS (SELECT lang, a, array_to_string(list_slice(w, s, s + m - 1), ' ') AS phrase
  FROM (SELECT lang, a, w, m, unnest(range(1, k - m + 2)) AS s FROM cand, (VALUES (2), (3)) v(m) WHERE m < k)),
longer AS (SELECT lang, phrase, max(a) AS most FROM parts GROUP BY ALL)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank, b.phrase, a, l, r, n, score
FROM best b JOIN totals t ON t.lang = b.lang LEFT JOIN longer x ON x.lang = b.lang AND x.phrase = b.phrase
WHERE most IS NULL OR CAST(100 AS HUGEINT) * most < CAST(80 AS HUGEINT) * a
QUALIFY rank <= 2000""",
}
