"""The registered queries and their SQL counterparts."""

from __future__ import annotations

from . import detection, live, recovery, reports, serving, streams

QUERIES = {**detection.QUERIES, **serving.QUERIES, **reports.QUERIES, **live.QUERIES, **recovery.QUERIES, **streams.QUERIES}
ORACLE_SQL = {**detection.ORACLE_SQL, **serving.ORACLE_SQL, **reports.ORACLE_SQL, **recovery.ORACLE_SQL, **streams.ORACLE_SQL}
