"""Cutting texts into chunks, as Python functions for model stages and as Spark columns."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_chunks(text: str, size: int) -> list[str]:
    """Windows of ``size`` characters and the tail."""
    return [text[i : i + size] for i in range(0, len(text), size)] if text else [""]


def split_evenly(text: str, parts: int) -> list[str]:
    """At most ``parts`` chunks of the same size, rounded up."""
    return fixed_chunks(text, max(1, math.ceil(len(text) / parts)))


def _windows(column: Column, size: Column) -> Column:
    n = F.greatest(F.ceil(F.length(column) / size), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(column, (i * size + 1).cast("int"), size.cast("int")))


def chunk_column(column: Column, size: int) -> Column:
    """``fixed_chunks`` as a column of arrays."""
    return _windows(column, F.lit(size))


def split_column(column: Column, parts: int) -> Column:
    """``split_evenly`` as a column of arrays."""
    return _windows(column, F.greatest(F.ceil(F.length(column) / F.lit(parts)), F.lit(1)))


def as_text(value) -> str:
    """A field as text; a list of strings as ``[a, b]``."""
    return f"[{', '.join(map(str, value))}]" if isinstance(value, (list, tuple, np.ndarray)) else "" if value is None else str(value)


def top_chunks(text: str, query: str, size: int, keep: int, embed: Callable[[list[str]], np.ndarray]) -> str:
    """The ``keep`` chunks nearest to the query, in their order, joined by ``...``; short texts stay whole."""
    if len(text) < size:
        return text
    chunks = fixed_chunks(text, size)
    vectors = embed([*chunks, query])
    norm = np.linalg.norm(vectors, axis=1)
    near = vectors[:-1] @ vectors[-1] / np.maximum(norm[:-1] * norm[-1], 1e-12)
    best = sorted(np.argsort(-near, kind="stable")[:keep].tolist())
    return "...".join(chunks[i] for i in best)
