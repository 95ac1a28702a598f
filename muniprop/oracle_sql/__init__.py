"""DuckDB oracle SQL per registered query (same fixture SQL, independent formulation)."""

from muniprop.oracle_sql import pipeline, reports, scalars, sources

ORACLES: dict[str, str] = {**reports.SQL, **pipeline.SQL, **scalars.SQL, **sources.SQL}
