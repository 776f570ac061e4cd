"""Event-study and signal analytics over daily series and news rows, as Spark DataFrame jobs."""

from tidemark.config import StudyConfig

__all__ = ["StudyConfig"]
