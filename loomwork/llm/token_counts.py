"""Token counts by a tokenizer compiled to a deterministic transducer (token_transducer).

Every transition carries the number of tokens it adds; texts are cut into chunks of fixed size,
each chunk is mapped for itself, and a scan composes the maps of a text. Counts equal those of the
tokenizers library without added special tokens; special strings inside a text count as one token.

Defined cases: a null text counts as empty (no bytes, no tokens); a null doc_id stays null;
repeated rows give repeated results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from loomwork.llm.common import bounded_batches, keep_id, released
from loomwork.llm.token_transducer import CHUNK, compiled, windows


def token_counts(df: DataFrame, tokenizer_file: str, limit: int, chunk: int = CHUNK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) for every row."""
    bounded_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in windows(batches, 1):
            texts = b.column(1).fill_null("")
            n = np.array(compiled(tokenizer_file).count_texts(texts, chunk), np.int64)
            columns = [b.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(columns, [id_col, "n_bytes", "n_tokens", "over_limit"])

    return keep_id(df, id_col, text_col).mapInArrow(released(run), f"`{id_col}` long, n_bytes long, n_tokens long, over_limit boolean")
