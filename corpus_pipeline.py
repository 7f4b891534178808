"""The pipeline of ``paperloom.llm.pipeline`` under the name by which tools look for it."""

from __future__ import annotations

from paperloom.llm.pipeline import ORACLE_SQL, STAGES, mixed, packed, run, without_copies, without_near_copies, without_toxic

__all__ = ["ORACLE_SQL", "STAGES", "mixed", "packed", "run", "without_copies", "without_near_copies", "without_toxic"]
