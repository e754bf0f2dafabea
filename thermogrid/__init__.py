"""thermogrid: urban-heat analytics written as Spark DataFrame operators."""

__all__ = ["functions", "operators", "plans", "sources", "streaming", "session"]
