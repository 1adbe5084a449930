"""Registered queries of the operators on conversations, token groups and licences, with their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tallyworth.llm import alignment, conversations, licenses
from tallyworth.llm.common import table


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return conversations.damaged_and_repaired(table(spark, folder, "conversations"))


def _way(edit: str, rest: str, cost: str, entry: str = "") -> str:
    """SQL of a repair that starts with `edit` and goes on as `rest`: cost, audit, repaired rows."""
    rows = f"list_prepend({entry}, {rest}.x)" if entry else f"{rest}.x"
    return f"{{'c': {rest}.c + {cost}, 'a': '{edit}' || {rest}.a, 'x': {rows}}}"


def _best(state: str, target: str, keeps: dict[str, str]) -> str:
    """SQL of the best repair from one grammar state that does not start with an insertion."""
    name = "assistant" if target == "a" else "user"
    kept = " ".join(f"WHEN '{r}' THEN [{_way('K', q, 't', kept_row)}]" for r, q in keeps.items() for kept_row in ["role || ':' || text"])
    kept_rows = f"CASE r {kept} ELSE [] END"
    reroled = _way("R", target, "t + 3", f"'{name}:' || text")
    return f"list_min([{_way('D', state, '4')}] || CASE WHEN fault IN ('b', 'd') THEN [] ELSE [{reroled}] || {kept_rows} END)"


OP11_SQL = rf"""
WITH RECURSIVE fated AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        xor(list_reduce(list_prepend(4294967295::BIGINT,
            list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)),
            lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda y, z: xor(y >> 1, 3988292384::BIGINT * (y & 1)))),
            4294967295::BIGINT) % 20 AS fate
    FROM conversations),
damaged AS (
    SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
        CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(CASE WHEN fate = 3 THEN [1, 2] ELSE [1] END) AS copy
    FROM fated WHERE fate <> 0),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS seen FROM damaged),
placed AS (
    SELECT conv_id, turn, role, text, seen, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS r,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, seen) AS pos FROM numbered),
marked AS (
    SELECT *, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS t, lag(r) OVER (PARTITION BY conv_id ORDER BY pos) || r AS pair
    FROM (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN seen > 1 THEN 'd'
        WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE 'n' END AS fault FROM placed)),
counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
        count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS size FROM marked GROUP BY conv_id),
ends AS (SELECT 0::BIGINT AS z, ['user:', 'assistant:']::VARCHAR[] AS ua, ['assistant:']::VARCHAR[] AS a, []::VARCHAR[] AS n),
costs AS (
    SELECT conv_id, size AS pos, {{'c': z, 'a': '', 'x': n}} AS o, {{'c': z + 6, 'a': 'II', 'x': ua}} AS s,
        {{'c': z + 3, 'a': 'I', 'x': e.a}} AS u, {{'c': z, 'a': '', 'x': n}} AS a FROM counts, ends e
    UNION ALL
    SELECT conv_id, pos, list_min([bo, {_way("I", "fu", "3", "'user:'")}]), list_min([bs, {_way("I", "fu", "3", "'user:'")}]), fu,
        list_min([ba, {_way("I", "bu", "3", "'user:'")}])
    FROM (SELECT *, list_min([bu, {_way("I", "ba", "3", "'assistant:'")}]) AS fu
        FROM (SELECT d.conv_id, d.pos - 1 AS pos, {_best("o", "u", {"s": "s", "u": "u"})} AS bo, {_best("s", "u", {"u": "u"})} AS bs,
            {_best("u", "a", {"a": "a"})} AS bu, {_best("a", "u", {"u": "u"})} AS ba
            FROM costs d JOIN marked m ON m.conv_id IS NOT DISTINCT FROM d.conv_id AND m.pos = d.pos))),
whole AS (SELECT conv_id, o FROM costs WHERE pos = 0)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(o.c, 0) AS cost, coalesce(o.a, '') AS audit,
    sha256(coalesce(array_to_string(o.x, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN whole w ON w.conv_id IS NOT DISTINCT FROM i.conv_id
"""


def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    first, second = public_tokenizers.path(alignment.FIRST), public_tokenizers.path(alignment.SECOND)
    return alignment.alignment(table(spark, folder, "documents"), first, second)


def op13_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licences(table(spark, folder, "documents"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in row) + ")" for row in rows)


_TEMPLATES = [(k, t.label, len(t.words), t.least, t.base, len(t.phrases)) for k, t in enumerate(licenses.TEMPLATES)]
_NOTICE_WORDS = [(k, p, w) for k, t in enumerate(licenses.TEMPLATES) for p, w in enumerate(t.words)]
_PHRASES = [(k, j, len(x)) for k, t in enumerate(licenses.TEMPLATES) for j, x in enumerate(t.phrases)]
_PHRASE_WORDS = [(k, j, p, w) for k, t in enumerate(licenses.TEMPLATES) for j, x in enumerate(t.phrases) for p, w in enumerate(x)]

OP13_SQL = rf"""
WITH templates AS (SELECT * FROM (VALUES {_values(_TEMPLATES)}) x(k, label, size, least, base, phrases)),
notice AS (SELECT * FROM (VALUES {_values(_NOTICE_WORDS)}) x(k, p, w)),
phrase AS (SELECT * FROM (VALUES {_values(_PHRASES)}) x(k, j, size)),
phrase_words AS (SELECT * FROM (VALUES {_values(_PHRASE_WORDS)}) x(k, j, p, w)),
docs AS (
    SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents),
held AS (SELECT n, i, w FROM (SELECT n, generate_subscripts(words, 1) - 1 AS i, unnest(words) AS w FROM docs) WHERE w IN (SELECT w FROM notice)),
aligned AS (SELECT n, k, i - p AS place, count(*) AS hits FROM held JOIN notice USING (w) GROUP BY n, k, place),
enough AS (SELECT a.*, label, size, base, phrases FROM aligned a JOIN templates USING (k) WHERE hits >= least),
said AS (
    SELECT n, k, j, i - p AS s, phrase.size FROM held JOIN phrase_words USING (w) JOIN phrase USING (k, j)
    GROUP BY n, k, j, s, phrase.size HAVING count(*) = phrase.size),
stands AS (
    SELECT * FROM enough e WHERE phrases = (SELECT count(DISTINCT j) FROM said WHERE said.n = e.n AND said.k = e.k
        AND s >= place AND s + said.size <= place + e.size)),
judged AS (
    SELECT n, count(*) FILTER (base) AS n_base, min(place) FILTER (base) AS first_word, max(place) FILTER (base) AS last_word,
        string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
        max(hits::DOUBLE / size::DOUBLE) AS score FROM stands GROUP BY n)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
    coalesce(labels, '') AS labels, coalesce(score, 0.0::DOUBLE) AS score
FROM docs LEFT JOIN judged USING (n)
"""


QUERIES = {f.__name__: f for f in (op11_conversation_repair, op12_token_alignment, op13_license_scan)}
SQL = {"op11_conversation_repair": OP11_SQL, "op13_license_scan": OP13_SQL}
