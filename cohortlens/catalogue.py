"""Registered queries of the cohort operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cohortlens.plans import cohort, enrichment, files, ranks, sequences, spans

MODULES = (cohort, ranks, spans, enrichment, sequences, files)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in MODULES for k, f in m.Q.queries.items()}
ORACLES: dict[str, str] = {k: sql for m in MODULES for k, sql in m.Q.oracles.items()}
