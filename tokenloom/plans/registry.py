"""Name to query, and name to DuckDB SQL of the same rows. Extend with @query."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The document corpus in DuckDB: tok(binary, category, func, i, opcode) and pos(..., pos, opcode).
TOK = """tok AS (
    SELECT source || '/' || lang AS binary, lang AS category, doc_id AS func, unnest(range(len(w))) AS i, unnest(w) AS opcode
    FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents)
), pos AS (
    SELECT binary, category, func, row_number() OVER (PARTITION BY binary ORDER BY func, i) - 1 AS pos, opcode FROM tok
)"""
#: The event corpus in DuckDB, with the same columns.
EVT = """tok AS (
    SELECT CAST(user_id AS VARCHAR) AS binary, NULL AS category, datediff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS func,
           row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY ts, event_id) - 1 AS i, event_type AS opcode
    FROM events
), pos AS (
    SELECT binary, category, func, row_number() OVER (PARTITION BY binary ORDER BY func, i) - 1 AS pos, opcode FROM tok
)"""


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir). sql may name {TOK} or {EVT}; a leading WITH is the query's own."""

    def add(f):
        QUERIES[name] = f
        if sql:
            # binary is a word of DuckDB's grammar
            ORACLES[name] = re.sub(r"\bbinary\b", '"binary"', sql.replace("{TOK}", TOK).replace("{EVT}", EVT))
        return f

    return add


def load() -> None:
    """Import the modules that register queries."""
    from . import clones, extras, frequency, information, kernels, relational, similarity, structure  # noqa: F401
