"""Token counts from pre-token frequencies: no list of ids is made for a document.

In each task every distinct pre-token's pieces are counted once by the model, the frequencies of each document's pre-tokens are
counted, and counts times frequencies are summed (``_pieces.Model``); only the counts are kept, no ids.  The join stays in the task: rows of (document,
pre-token, frequency) are larger than the texts themselves, and the table of distinct pre-tokens grows with the corpus
and can't be broadcast; a task needs only those that it meets.

Cases with a defined result: a null text counts as empty (0 bytes, 0 tokens); rows with null or repeated ids each get their
own row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._pieces import model, read_model
from ._store import small_batches

LIMIT = 4096


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit); path: of a SentencePiece model."""
    proto = read_model(path)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(proto, "count")
        for b in batches:
            sizes, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for c in X.chunks(b.column(1)):
                sizes.append(np.diff(c.offs))
                counts.append(m.count_tokens(c))
            n = np.concatenate(counts)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(sizes)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return own.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
