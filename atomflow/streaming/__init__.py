"""Running flows over unbounded streams, one atom per micro-batch."""

from atomflow.streaming.runtime import Runtime, run_atoms

__all__ = ["Runtime", "run_atoms"]
