"""All queries of the engine by name, and the SQL that gives the same rows."""

from __future__ import annotations

from loomwright.plans import evidence, histories, judgement, kinship, lexicon, likeness, limits, matching, meta, monitoring, naming, signals, stored, tables, texts, trending, upkeep, vectors
from loomwright.streaming import events, maintenance

_PACKS = (monitoring, histories, texts, evidence, judgement, vectors, upkeep, kinship, lexicon, likeness, limits, matching, meta, naming, tables, signals, stored, trending, events, maintenance)

QUERIES = {name: query for pack in _PACKS for name, query in pack.QUERIES.items()}
ORACLE_SQL = {name: sql for pack in _PACKS for name, sql in pack.ORACLE_SQL.items()}
