"""Document-corpus processing and retrieval as Spark DataFrame jobs."""

__all__ = ["functions", "operators", "sources", "streaming", "plans"]
