"""Reading the given tables and walking Arrow batches in bounded pieces."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Characters of text held at once by the vectorised kernels; a longer document is a piece of its own.
PIECE = 2_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Path of a public tokenizer's file, the same on every host."""
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = PIECE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """(rows, texts) of at most *limit* characters, or one row; a null text counts as empty."""
    for batch in batches:
        texts = [t or "" for t in batch.column(text).to_pylist()]
        start = size = 0
        for i, t in enumerate(texts):
            if i > start and size + len(t) > limit:
                yield batch.slice(start, i - start), texts[start:i]
                start, size = i, 0
            size += len(t)
        if start < len(texts):
            yield batch.slice(start), texts[start:]


def record(**columns) -> pa.RecordBatch:
    """A record batch from numpy arrays, lists or Arrow arrays."""
    return pa.RecordBatch.from_arrays(
        [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c) for c in columns.values()], list(columns))
