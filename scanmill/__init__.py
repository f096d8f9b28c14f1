"""Search over large web corpora by scanning them, as Spark DataFrame jobs."""

from scanmill.runtime import ship

__all__ = ["ship"]
