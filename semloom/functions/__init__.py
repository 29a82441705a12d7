"""Column and text functions shared by the operators."""

from .chunks import chunk_column, fixed_chunks, split_column, split_evenly, top_chunks
from .parsing import parse_answer_json, parse_boolean, shape_many
from .vectors import cosine

__all__ = ["chunk_column", "cosine", "fixed_chunks", "parse_answer_json", "parse_boolean", "shape_many", "split_column", "split_evenly", "top_chunks"]
