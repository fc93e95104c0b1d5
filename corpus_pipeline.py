"""The corpus pipeline: STAGES, run and ORACLE_SQL, from the package of the training-data operators."""

from panelspark.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
