"""Token counts: batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.llm.vocabularies import by_size, count, pieces

LIMIT = 1024


def lengths(texts: Iterable[str | None], path: str) -> np.ndarray:
    """Tokens of each text (null: empty); the encoder sees batches of pieces of about equal size."""
    owner: list[int] = []

    def parts() -> Iterator[str]:
        for i, t in enumerate(texts):
            for p in pieces(t or ""):
                owner.append(i)
                yield p

    counts = [n for group in by_size(parts()) for n in count(group, path)]
    return np.bincount(owner, weights=counts, minlength=0).astype(np.int64) if owner else np.zeros(0, np.int64)


def count_tokens(docs: DataFrame, tokenizer_file: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """One row per input row: id, n_bytes (UTF-8), n_tokens, over_limit (n_tokens > limit).

    tokenizer_file: a tokenizers .json that every executor can read.  Counts are those of the whole text, without
    begin or end tokens, truncation or padding; special strings are encoded as the library does by default.  A null
    text counts as empty; a text of any length is cut only where the count cannot change.  Repeated rows return as
    often as they stand; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array(lengths((t.as_py() for t in batch.column(2)), tokenizer_file))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    counted = rows.mapInArrow(work, f"id {kind}, n_bytes long, n_tokens long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
