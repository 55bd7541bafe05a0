"""The corpus pipeline: STAGES, run and ORACLE_SQL of atomflow.llm.pipeline."""

from atomflow.llm.pipeline import ORACLE_SQL, STAGES, exact, near, packing, repeats, run, toxicity

__all__ = ["ORACLE_SQL", "STAGES", "exact", "near", "packing", "repeats", "run", "toxicity"]
