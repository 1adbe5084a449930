"""All queries of this subpackage."""

from __future__ import annotations

from tallyworth.llm import queries_four, queries_one, queries_three, queries_two

QUERIES = {**queries_one.QUERIES, **queries_two.QUERIES, **queries_three.QUERIES, **queries_four.QUERIES}
SQL = {**queries_one.SQL, **queries_two.SQL, **queries_three.SQL, **queries_four.SQL}
