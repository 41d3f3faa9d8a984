"""Vector search over Parquet on Spark."""

from .plans import VectorSession, VectorTopKOptions, enable_vector_search
from .sources import IndexBuilder, IvfIndex, TopkBuilder, ensure_indexed, has_vector_index, read_index

__all__ = [
    "IndexBuilder", "IvfIndex", "TopkBuilder", "VectorSession", "VectorTopKOptions", "enable_vector_search",
    "ensure_indexed", "has_vector_index", "read_index",
]
