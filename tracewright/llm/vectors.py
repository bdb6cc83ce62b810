"""Vectors as raw bytes, for operators that compute on them in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def raw_vectors(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, np.dtype]:
    """``id, raw`` of the vectors that take part, and the type of a component in ``raw``.

    Left out: null vectors, empty ones, those with a null or non-finite component and those of zeros only.
    """
    single = isinstance(df.schema[vec_col].dataType.elementType, T.FloatType)
    dtype = np.dtype("<f4" if single else "<f8")
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = df.select(F.col(id_col).alias("id"), F.col(vec_col).cast(f"array<{'float' if single else 'double'}>").alias("v"))
    rows = rows.where(v.isNotNull() & fine & F.exists(v, lambda x: x != 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = np.ascontiguousarray(b.column("v").flatten().to_numpy(zero_copy_only=False), dtype=dtype)
            ends = np.cumsum([0, *b.column("v").value_lengths().to_pylist()]) * dtype.itemsize
            raw = (flat + dtype.type(0)).tobytes()  # no negative zeros
            parts = [raw[s:e] for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(parts, pa.binary())], ["id", "raw"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, raw binary"), dtype


def matrix(raw, dtype: np.dtype, width: int = 0) -> np.ndarray:
    """Rows in double precision, shorter ones filled up with zeros to the longest or to ``width``."""
    raw = [bytes(r) for r in raw]
    width = max([width, *(len(r) // dtype.itemsize for r in raw)])
    full = width * dtype.itemsize
    return np.frombuffer(b"".join(r.ljust(full, b"\0") for r in raw), dtype=dtype).reshape(len(raw), width).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Between all rows of x and all of p."""
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1)[None, :] - 2.0 * (x @ p.T)))


def spread(x: np.ndarray, most: int, least: float) -> np.ndarray:
    """Farthest first: each row chosen is the one that is farthest from those before, until there are ``most`` or none is
    farther than ``least``."""
    chosen, near = [0], distances(x, x[:1])[:, 0]
    while len(chosen) < min(most, len(x)) and near.max() > least:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(x, x[chosen[-1:]])[:, 0])
    return x[chosen]
