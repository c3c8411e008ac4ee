"""The queries of this subpackage: one for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from polyloom.llm import bpe, decontaminate, jaccard, language, license, media, quality, secrets, sentences, suffixes
from polyloom.llm.common import crc, table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op2_sentence_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentences.remove_repeats(table(spark, sf_dir, "documents"), only_changed=True, whole=True)
    return found.select("doc_id", "n_sentences", "n_removed", F.sha2("text", 256).alias("kept_sha256"), "first_docs")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(crc(F.col("doc_id")) % 4 != 2))
    found = language.predict(docs, model)
    spans = F.array_join(F.transform("lang_spans", lambda x: F.concat_ws(":", x["lang"], x["first"].cast("string"), (x["first"] + x["words"]).cast("string"))), ",")
    return found.select("doc_id", (crc(F.col("doc_id")) % 4 == 2).alias("held_out"), "lang_pred", "score", "n_words", spans.alias("spans"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), ids=False, decoded=False)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(spark, docs, table(spark, sf_dir, "labels"), crc(F.col("doc_id")) % 3 != 1)
    scored = quality.score_documents(docs, model)
    return scored.select("doc_id", (crc(F.col("doc_id")) % 3 == 1).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license.scan(table(spark, sf_dir, "documents")).drop("license_spans")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.repeats(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["first"].cast("string"), x["last"].cast("string"))), ",")
    return found.select("doc_id", spans.alias("spans"), "n_words", "other_docs")


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents"), keep=False)


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secret_scan, op2_sentence_dedup, op3_language_id, op4_decontamination, op5_bpe, op6_quality, op7_license_scan, op8_suffix_dedup, op9_media_columns, op10_jaccard_join)}

ORACLE_SQL: dict[str, str] = {
    "op10_jaccard_join": r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[])
        WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), shared AS (SELECT shingle FROM s GROUP BY shingle HAVING count(*) > 1
), link AS (
    SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN shared USING (shingle) JOIN s b USING (shingle)
    JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
    WHERE a.doc_id <> b.doc_id AND 100 * least(na.n, nb.n) >= 80 * greatest(na.n, nb.n)
    GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach AS (SELECT doc_id AS x, doc_id AS y FROM n UNION SELECT reach.x, link.y FROM reach JOIN link ON reach.y = link.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(r.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) r USING (doc_id)
"""
}
