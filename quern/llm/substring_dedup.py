"""Substring dedup by relative Lempel-Ziv parsing over blocks of words.

The reference of a document is every document with a smaller id.  It is indexed in blocks that the content itself
delimits: the anchor of a window (``window`` consecutive words) is the least hash among its ``GRAM``-word grams, and a
block is a maximal run of windows with one anchor, so equal passages are cut alike in every document.  A block that an
earlier document holds whole is a match; where blocks of one anchor differ, their windows are matched one by one, so that a
match's boundary inside a block is found.  A document is then parsed greedily: matches that continue one another in the same
earlier document at the same distance are one maximal match, and at each place the match that reaches farthest becomes a factor,
behind which the parse goes on.  The factors are the duplicate spans.

Cases with a defined result: null and empty texts have no words; texts under one window keep all words; rows with a null
id are neither reference nor changed; rows that repeat an id are one document for the comparison of ids, and each row is
cut by its own text; further columns, also ones with the names used here, pass through ``remove_spans`` unchanged.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import discard, small_batches, written

WINDOW = 50
GRAM = 12


def _anchors(words: np.ndarray, first: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window start of the chunk's texts: its word index, text index and anchor."""
    m = len(words)
    sums = X.item_sums(words)
    at = np.arange(m - gram + 1)
    grams = X.span_hash(sums, at, at + gram)
    span, width, low = window - gram + 1, 1, grams
    while width * 2 <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: len(low) - (span - width)], low[span - width :])
    counts = np.diff(first)
    n_windows = np.maximum(counts - window + 1, 0)
    start = X.ragged(first[:-1], n_windows)
    return start, np.repeat(np.arange(len(counts)), n_windows), low[start]


def _blocks(ids: np.ndarray, tags: np.ndarray, words: np.ndarray, first: np.ndarray, window: int, gram: int) -> dict[str, np.ndarray] | None:
    """Blocks of each text: anchor, hash of all words of the block, first word and number of windows."""
    if len(words) < window:
        return None
    start, text, anchor = _anchors(words, first, window, gram)
    if not len(start):
        return None
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    n = np.diff(np.append(head, len(start)))
    a = start[head]
    return {
        "doc": ids[text[head]],
        "tag": tags[text[head]],
        "anchor": anchor[head].view(np.int64),
        "block": X.span_hash(X.item_sums(words), a, a + n + window - 1).view(np.int64),
        "a": (a - first[text[head]]).astype(np.int32),
        "n": n.astype(np.int32),
    }


def _block_mapper(window: int, gram: int):
    names = ["doc", "tag", "anchor", "block", "a", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            for c in X.chunks(b.column(2)):
                s, e, first = X.word_bounds(c.buf, c.offs)
                got = _blocks(ids[c.lo : c.hi], tags[c.lo : c.hi], X.bytes_hash(c.buf, s, e), first, window, gram)
                if got:
                    yield pa.RecordBatch.from_arrays([pa.array(got[k]) for k in names], names)

    return run


def _window_mapper(window: int, gram: int):
    """Every window of the listed blocks with its anchor and hash."""
    names = ["doc", "tag", "anchor", "hash", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, tags = b.column(0).to_numpy(), b.column(1).to_numpy()
            a_all, n_all = b.column(3), b.column(4)
            for c in X.chunks(b.column(2)):
                s, e, first = X.word_bounds(c.buf, c.offs)
                words = X.bytes_hash(c.buf, s, e)
                sums = X.item_sums(words)
                take = range(c.lo, c.hi)
                a = [a_all[i].values.to_numpy() for i in take]
                n = [n_all[i].values.to_numpy() for i in take]
                per = np.array([int(x.sum()) for x in n])
                at = np.concatenate([X.ragged(x.astype(np.int64), y) for x, y in zip(a, n, strict=True)])
                text = np.repeat(np.arange(len(per)), per)
                start = at + first[text]
                grams_at = np.arange(len(words) - gram + 1)
                grams = X.span_hash(sums, grams_at, grams_at + gram)
                anchor = np.lib.stride_tricks.sliding_window_view(grams, window - gram + 1)[start].min(axis=1) if len(start) else grams[:0]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[c.lo : c.hi][text]),
                        pa.array(tags[c.lo : c.hi][text]),
                        pa.array(anchor.view(np.int64)),
                        pa.array(X.span_hash(sums, start, start + window).view(np.int64)),
                        pa.array(at.astype(np.int32)),
                    ],
                    names,
                )

    return run


def duplicate_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """Matches of words with an earlier document: doc, tag (a hash that tells rows of one id apart), at, len, origin (that document) and shift (where it stands there, less at).

    Matches of one document may overlap; their union is what ``window``-word windows of documents with a smaller id cover.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc"), F.hash("text").alias("tag"), F.col("text").alias("text"))
    own = own.where("doc is not null and text is not null")
    blocks = written(own.mapInArrow(_block_mapper(window, gram), "doc long, tag int, anchor long, block long, a int, n int"), "blocks")
    # An anchor that one document alone has can't be in a duplicate; most are so, and go before any other shuffle.
    shared = (
        blocks.groupBy("anchor")
        .agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("block").alias("b0"), F.max("block").alias("b1"))
        .where("lo < hi")
        .select("anchor", (F.col("b0") != F.col("b1")).alias("contested"))
    )
    met = written(blocks.join(shared, "anchor"), "met")
    key = ["anchor", "block", "n"]
    index = written(met.groupBy(*key).agg(F.min(F.struct("doc", "a")).alias("first")).select(*key, F.col("first.doc").alias("origin"), F.col("first.a").alias("origin_at")), "index")  # a table of its own, as below
    parsed = written(met.join(index, key), "parsed")
    discard(blocks, met, index)
    whole = parsed.where("doc > origin").select("doc", "tag", F.col("a").alias("at"), (F.col("n") + F.lit(window - 1)).alias("len"), "origin", (F.col("origin_at") - F.col("a")).alias("shift"))
    # What no earlier document holds whole may still overlap other blocks of its anchor: check at the boundary.
    open_blocks = parsed.where("contested and doc = origin").groupBy("doc", "tag").agg(F.collect_list(F.struct("a", "n")).alias("list"))
    windows = written(
        own.join(open_blocks, ["doc", "tag"])
        .select("doc", "tag", "text", F.col("list.a").alias("a"), F.col("list.n").alias("n"))
        .mapInArrow(_window_mapper(window, gram), "doc long, tag int, anchor long, hash long, at int"),
        "windows",
    )
    # As a table of its own: joined to it, a passage with very many windows can be split among tasks.
    first = windows.groupBy("anchor", "hash").agg(F.min(F.struct("doc", "at")).alias("first"), F.max("doc").alias("hi")).where("first.doc < hi")
    first = written(first.select("anchor", "hash", F.col("first.doc").alias("origin"), F.col("first.at").alias("origin_at")), "first")
    edge = windows.join(first, ["anchor", "hash"]).where("doc > origin").select("doc", "tag", "at", F.lit(window).alias("len"), "origin", (F.col("origin_at") - F.col("at")).alias("shift"))
    return whole.unionByName(edge)


def parse(at: np.ndarray, size: np.ndarray, origin: np.ndarray, shift: np.ndarray) -> list[tuple[int, int]]:
    """The factors (first word, end) of one document's greedy parse."""
    order = np.lexsort((at, shift, origin))
    a, e, o, d = at[order].astype(np.int64), (at + size)[order].astype(np.int64), origin[order], shift[order]
    new = np.ones(len(a), bool)  # a match that doesn't continue the one before it
    new[1:] = (o[1:] != o[:-1]) | (d[1:] != d[:-1]) | (a[1:] > e[:-1])
    head = np.flatnonzero(new)
    a, e = a[head], np.maximum.reduceat(e, head)
    order = np.argsort(a, kind="stable")
    out: list[tuple[int, int]] = []
    place, far = 0, -1
    for x, y in zip(a[order].tolist(), e[order].tolist(), strict=True):
        if x > place and far > place:  # nothing else begins before here
            out.append((place, far))
            place = far
        if far <= place:
            place = max(place, x)
        far = max(far, y)
    if far > place:
        out.append((place, far))
    return out


def _keep_mask(spans: tuple[np.ndarray, ...] | None, words: int) -> np.ndarray | None:
    """Which words of a text stay; None where all do."""
    if spans is None or not len(spans[0]) or not words:
        return None
    keep = np.ones(words, bool)
    for a, e in parse(*spans):
        keep[a:e] = False
    return keep


def _with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with a column __spans: the spans found in that row's text (rows of one id are told apart by their text)."""
    per = spans.groupBy(F.col("doc").alias("__doc"), F.col("tag").alias("__tag")).agg(F.collect_list(F.struct("at", "len", "origin", "shift")).alias("__spans"))
    keyed = docs.withColumn("__of", F.col("doc_id").cast("long")).withColumn("__hash", F.hash("text"))
    return keyed.join(per, (F.col("__of") == F.col("__doc")) & (F.col("__hash") == F.col("__tag")), "left").drop("__of", "__hash", "__doc", "__tag")


def _lists(col: pa.Array) -> list[tuple[np.ndarray, ...] | None]:
    out = []
    for x in col:
        v = x.values
        out.append(None if v is None else tuple(v.field(k).to_numpy() for k in ("at", "len", "origin", "shift")))
    return out


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        spans = _lists(b.column(2))
        n_words, n_removed, sha = [], [], []
        for text, span in zip(b.column(1), spans, strict=True):
            words = (text.as_py() or "").encode().split()
            keep = _keep_mask(span, len(words))
            kept = words if keep is None else list(compress(words, keep.tolist()))
            n_words.append(len(words))
            n_removed.append(len(words) - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def kept_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 (of the kept words, joined by one space)."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return _with_spans(own, duplicate_spans(own, window)).mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _cut(text: str, keep: np.ndarray) -> str:
    """The text without the words that go; white space before a kept word stays as it was."""
    raw = text.encode()
    buf = np.frombuffer(raw, np.uint8)
    s, e, _ = X.word_bounds(buf, np.array([0, len(buf)]))
    begin = np.concatenate(([0], e[:-1]))
    parts = [raw[x:y] for x, y in zip(begin[keep].tolist(), e[keep].tolist(), strict=True)]
    if len(keep) and keep[-1]:
        parts.append(raw[e[-1] :])
    return b"".join(parts).lstrip(b" \t\n\v\f\r").decode() if not (len(keep) and keep[0]) else b"".join(parts).decode()


def remove_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with their duplicate spans cut out of ``text``; all columns and rows stay.

    A text of which nothing is left becomes empty.  A column ``n_chars`` is set to the new number of code points.
    """
    cols = docs.columns
    joined = _with_spans(docs, duplicate_spans(docs, window))

    @F.pandas_udf("string")
    def cut(text, at, size, origin, shift):  # noqa: ANN001
        import pandas as pd

        out = []
        for t, *span in zip(text, at, size, origin, shift, strict=True):
            if t is None or span[0] is None or not len(span[0]):
                out.append(t)
                continue
            keep = _keep_mask(tuple(map(np.asarray, span)), len(t.encode().split()))
            out.append(t if keep is None or keep.all() else _cut(t, keep))
        return pd.Series(out, dtype=object)

    new = F.when(F.col("__spans").isNull(), F.col("text")).otherwise(cut("text", *(F.col(f"__spans.{k}") for k in ("at", "len", "origin", "shift"))))
    done = joined.withColumn("text", new)
    if "n_chars" in cols:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*[F.col(f"`{c}`") for c in cols])
