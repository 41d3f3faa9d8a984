"""Vectors that arrive on a stream."""

from .assign import assign_stream

__all__ = ["assign_stream"]
