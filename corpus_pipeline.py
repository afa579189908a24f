"""A pipeline of the operators in ``codefacts.llm``: documents in, packed sequences out."""

from codefacts.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
