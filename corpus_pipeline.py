"""Documents to packed sequences: the stages are in ``ledgerwatch.llm.pipeline``."""

from ledgerwatch.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
