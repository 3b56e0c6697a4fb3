"""The training corpus pipeline: its stages are in `tidemark.llm.pipeline`."""

from tidemark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
