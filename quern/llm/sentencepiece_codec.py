"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised through the model's compiled character map, longest key first, with the source offset of every byte
(``_pieces.CharMap``); pieces found in the normal form are projected back to byte spans of the original text.  The ids are
those of the library: it encodes every distinct pre-token, and models that can't be cut so are applied to whole texts.

Cases with a defined result: a null text is encoded as an empty one (begin and end id only); ids, spans and digests are
per row, so null and repeated ids are kept as they are; an empty table gives an empty result; further columns are
ignored by ``encode`` and ``digest``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._pieces import model, read_model
from ._store import small_batches


def _own(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, ids, and the byte span (begins, ends) of each id in the UTF-8 text; no begin and end ids."""
    proto = read_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(proto, "encode")
        for b in batches:
            for c in X.chunks(b.column(1)):
                ids, first, *spans = m.encode(c)
                cut = pa.array(first.astype(np.int32))
                flat = [pa.ListArray.from_arrays(cut, pa.array(x.astype(np.int32))) for x in spans]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[c.lo : c.hi], pa.ListArray.from_arrays(cut, pa.array(ids)), *flat], ["doc_id", "ids", "begins", "ends"]
                )

    return _own(docs).mapInArrow(run, "doc_id long, ids array<int>, begins array<int>, ends array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id and the text that its ids spell; begin and end ids spell nothing, null ids are an empty list."""
    proto = read_model(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(proto, "encode")
        for b in batches:
            lists = b.column(1).fill_null([]) if b.column(1).null_count else b.column(1)
            first = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
            texts = m.decode(lists.flatten().to_numpy(zero_copy_only=False), first)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.decode(errors="replace") for x in texts], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, path: str) -> DataFrame:
    """Per row: doc_id, n_tokens (with begin and end ids), ids_sha256 (little-endian 32-bit ids), decoded_sha256.

    Also spans_sha256 (of first and end byte of each id in turn, as such integers, without begin and end ids), and covered: the spans
    follow one another from the first byte of the text to its last.
    """
    proto = read_model(path)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "spans_sha256", "covered"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(proto, "encode")
        bos, eos = (np.array([x], "<u4").tobytes() for x in (m.bos, m.eos))
        for b in batches:
            n, coded, spelled, placed, whole = [np.zeros(0, np.int64)], [], [], [], [np.zeros(0, bool)]
            for c in X.chunks(b.column(1)):
                ids, first, begin, end = m.encode(c)
                n.append(np.diff(first) + 2)
                raw, spans = ids.astype("<u4").tobytes(), np.column_stack((begin, end)).astype("<u4").tobytes()
                cuts = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                coded += [hashlib.sha256(bos + raw[4 * x : 4 * y] + eos).hexdigest() for x, y in cuts]
                placed += [hashlib.sha256(spans[8 * x : 8 * y]).hexdigest() for x, y in cuts]
                spelled += [hashlib.sha256(x).hexdigest() for x in m.decode(ids, first)]
                some = np.diff(first) > 0
                head, last = first[:-1][some], first[1:][some] - 1
                follows = begin[1:] == end[:-1]
                follows[head[1:] - 1] = True
                ok = np.diff(c.offs) == 0
                if len(head):
                    ok[some] = np.logical_and.reduceat(np.append(follows, True), head) & (begin[head] == 0) & (end[last] == np.diff(c.offs)[some])
                whole.append(ok)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(np.concatenate(n)), *(pa.array(x, pa.string()) for x in (coded, spelled, placed)), pa.array(np.concatenate(whole))], names
            )

    return _own(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, spans_sha256 string, covered boolean")
