"""Registered queries of the operators that compare texts with each other, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyworth.llm import jaccard, repeats
from tallyworth.llm.common import table
from tallyworth.llm.url_filter import LOWER, UPPER


def op8_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, folder, "documents"), words=3, num=90, den=100)


def op10_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeats.without_repeats(table(spark, folder, "documents"), with_bytes=False)


OP8_SQL = rf"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
items AS MATERIALIZED (SELECT doc_id, unnest(s) AS x FROM sets),
links AS MATERIALIZED (
    SELECT a, b FROM (
        SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n FROM items p JOIN items q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY ALL)
    JOIN sets sa ON sa.doc_id = a JOIN sets sb ON sb.doc_id = b WHERE 100 * n >= 90 * (len(sa.s) + len(sb.s) - n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sets UNION SELECT r.a, w.b FROM reach r JOIN ways w ON w.a = r.b)
SELECT r.a AS doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id
FROM reach r JOIN sets s ON s.doc_id = r.a GROUP BY r.a, len(s.s)
"""

OP10_SQL = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT doc_id, unnest(range(0, len(h) // 2 - 99)) AS p, h FROM raw),
windows AS (SELECT doc_id, p, substr(h, 2 * p + 1, 200) AS s FROM starts),
hits AS (
    SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM windows) WHERE k > 1),
marked AS (
    SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS opens FROM hits),
numbered AS (SELECT doc_id, p, sum(opens) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM marked),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (
    SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS b FROM (
        SELECT doc_id, a, b FROM spans UNION ALL SELECT doc_id, len(h) // 2, len(h) // 2 FROM raw)),
kept AS (
    SELECT g.doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS k FROM gaps g JOIN raw USING (doc_id) GROUP BY g.doc_id),
counted AS (SELECT doc_id, count(*) AS n, sum(b - a) AS gone FROM spans GROUP BY doc_id)
SELECT r.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
    CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM raw r LEFT JOIN kept USING (doc_id) LEFT JOIN counted USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (op8_jaccard_join, op10_repeats)}
SQL = {"op8_jaccard_join": OP8_SQL, "op10_repeats": OP10_SQL}
