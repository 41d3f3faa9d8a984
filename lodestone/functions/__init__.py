"""Column functions over vectors."""

from .distance import array_distance, l2_distance, register, squared_l2, squared_l2_to
from .recall import mean_recall, recall_at_k
from .validate import check_column, check_vectors, vector_column, vector_dim, vector_report

__all__ = [
    "array_distance", "check_column", "check_vectors", "l2_distance", "mean_recall", "recall_at_k",
    "register", "squared_l2", "squared_l2_to", "vector_column", "vector_dim", "vector_report",
]
