"""Indexes on disk: building, finding and reading them; sources for benches and tests."""

from .index import IndexBuilder, IvfIndex, TopkBuilder, ensure_indexed, has_vector_index, read_index
from .tables import embedding_at, generate, identified

__all__ = [
    "IndexBuilder", "IvfIndex", "TopkBuilder", "embedding_at", "ensure_indexed", "generate",
    "has_vector_index", "identified", "read_index",
]
