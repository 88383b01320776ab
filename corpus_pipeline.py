"""The corpus pipeline's entry: its stages are in parchmint.llm.pipeline."""

from parchmint.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
