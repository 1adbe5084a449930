"""Registered queries of the operators that learn, mix, pack and archive, with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworth.llm import language, mixing, packing, warc
from tallyworth.llm.common import table


def op2_mixing(spark: SparkSession, folder: str) -> DataFrame:
    drawn = mixing.mix(table(spark, folder, "documents"))
    return drawn.select("doc_id", "source", "tokens", F.round("weight", 9).alias("weight"), "epoch", "block", "place")


def op3_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(packing.VOCABULARY))


def op7_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.train(language.learning_rows(docs))
    held_out = F.coalesce(language.remainder() == 1, F.lit(False)).alias("held_out")
    judged = language.identify(docs.select("doc_id", "text", held_out), model)
    return judged.select("doc_id", "held_out", "lang_pred", "score", "languages")


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    def page(name: str):
        return F.regexp_extract(name, "^urn:page:(-?[0-9]+)", 1).try_cast("long")

    read = warc.archived(table(spark, folder, "pages"))
    return read.select(
        page("name").alias("page_id"),
        F.col("bytes").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        "record_type",
        F.when(F.col("refers_to").isNotNull(), page("refers_to")).alias("refers_to"),
    )


_DIGITS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
OP9_SQL = f"""
WITH bodies AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
sums AS (SELECT page_id, octet_length(body) AS size, sha1(body) AS h, max(page_id) OVER (PARTITION BY body) AS last FROM bodies)
SELECT page_id, CAST(size AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(32), lambda i: substr({_DIGITS},
        CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1)), '') AS payload_digest,
    CASE WHEN page_id IS NOT DISTINCT FROM last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM sums
"""

QUERIES = {f.__name__: f for f in (op2_mixing, op3_packing, op7_language_id, op9_warc)}
SQL = {"op9_warc": OP9_SQL}
