"""Registered queries of the operators on single rows and equal rows, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyworth.llm import exact_dedup, pii, quality, url_filter
from tallyworth.llm.common import table


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


OP1_SQL = r"""
WITH n AS (
    SELECT doc_id, length(coalesce(text, '')) AS size,
        regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
    row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY size DESC, doc_id NULLS LAST)
"""


def op4_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality_verdicts(table(spark, folder, "documents")).drop("distance")


def op5_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """A page's outcome is the label of the document with its number: bad if of low quality or toxic."""
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("page_id"), bad.alias("bad"))
    judged = url_filter.judge_urls(table(spark, folder, "pages"), outcomes)
    return judged.withColumns({c: F.round(c, 6) for c in ("bad_rate", "bound")})


def _strength_sql(units: str) -> str:
    """One row `m`: the prior strength of a beta-binomial over `units` (n, bad)."""
    return f"""(
    SELECT CASE WHEN k < 2 OR sp = 0 OR fr <= 0 OR (bb - bd * (bd / tn) - (k - 1) * sp) <= 0 THEN 1000.0
        ELSE least(1000.0, greatest(1.0, (1 - (bb - bd * (bd / tn) - (k - 1) * sp) / (sp * fr))
            / ((bb - bd * (bd / tn) - (k - 1) * sp) / (sp * fr)))) END AS m
    FROM (SELECT k, tn, bd, bb, (bd / tn) * (1 - bd / tn) AS sp, tn - nn / tn - (k - 1) AS fr
        FROM (SELECT count(*) AS k, sum(n)::DOUBLE AS tn, sum(bad)::DOUBLE AS bd, sum(n::DOUBLE * n) AS nn,
            sum(bad::DOUBLE * bad / n) AS bb FROM {units} WHERE n > 0)))"""


def _last(labels: int) -> str:
    """The last labels of a host in SQL; all listed suffixes have two."""
    return f"array_to_string(list_slice(string_split(name, '.'), -{labels}, -1), '.')"


OP5_SQL = rf"""
WITH rest AS (
    SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
split AS (
    SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host,
        regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
bare AS (
    SELECT host, regexp_replace(host, '{url_filter.LEFT_OUT}', '', 'g') AS name, count(bad) AS n, coalesce(sum(bad), 0) AS bad
    FROM split LEFT JOIN known USING (page_id) GROUP BY host),
hosts AS (
    SELECT host, n, bad, CASE WHEN numeric THEN name WHEN listed THEN {_last(3)} ELSE {_last(2)} END AS domain,
        CASE WHEN numeric THEN '' WHEN listed THEN {_last(2)} ELSE {_last(1)} END AS suffix
    FROM (SELECT *, regexp_matches(name, '{url_filter.NUMERIC}') AS numeric,
        {_last(2)} IN ({", ".join(f"'{s}'" for s in url_filter.SUFFIXES)}) AS listed FROM bare)),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY domain, suffix),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY suffix),
ms AS (SELECT * FROM {_strength_sql("suffixes")}), md AS (SELECT * FROM {_strength_sql("domains")}),
mh AS (SELECT * FROM {_strength_sql("hosts")}),
overall AS (SELECT (sum(bad) + 1.0::DOUBLE) / (sum(n) + 2.0::DOUBLE) AS p FROM hosts),
by_suffix AS (SELECT suffix, (bad + p * m) / (n + m) AS r FROM suffixes, ms, overall),
by_domain AS (SELECT domain, d.suffix, (bad + r * m) / (n + m) AS r FROM domains d JOIN by_suffix USING (suffix), md),
by_host AS (
    SELECT host, x AS bad_rate, x - 1.645::DOUBLE * sqrt(x * (1 - x) / (n + m + 1)) AS bound
    FROM (SELECT host, n, m, (h.bad + r * m) / (n + m) AS x FROM hosts h JOIN by_domain d ON d.domain = h.domain AND d.suffix = h.suffix, mh)),
rules AS (SELECT * FROM (VALUES {", ".join(f"('{r.rule}', '{r.host}', '{r.path}', '{r.verdict}')" for r in url_filter.RULES)}) t(rule, rh, rp, v)),
fit AS (
    SELECT page_id, host, path, rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC NULLS LAST) AS k
    FROM split LEFT JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, f.host, path, rule, coalesce(v, CASE WHEN bound > 0.5 THEN 'block' ELSE 'allow' END) AS verdict,
    round(bad_rate, 6) AS bad_rate, round(bound, 6) AS bound
FROM fit f JOIN by_host USING (host) WHERE k = 1
"""


def op6_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    found = pii.personal_data(table(spark, folder, "documents"))

    def joined(spans):
        text = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(text, ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE_KINDS))

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(kind) for kind in pii.BASE_KINDS]
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), scores.alias("scores"))


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op4_quality_rules, op5_url_filter, op6_personal_data)}
SQL = {"op1_exact_dedup": OP1_SQL, "op5_url_filter": OP5_SQL}
