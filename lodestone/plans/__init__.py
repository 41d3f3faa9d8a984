"""SQL over indexed tables, its options and its metrics."""

from .session import VectorSession, VectorTopKOptions, enable_vector_search

__all__ = ["VectorSession", "VectorTopKOptions", "enable_vector_search"]
