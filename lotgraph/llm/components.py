"""Connected components of an edge table."""

from lotgraph.llm.spread import components

__all__ = ["components"]
