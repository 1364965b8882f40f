"""Fill-in-the-middle: documents cut into prefix, middle and suffix, and put together anew for training.

Each text is decoded to an array of UTF-32 code points.  Neighbouring code points of different classes have a boundary
between them; two boundaries are chosen by their ranks, and the pieces are sliced and encoded again.  What the classes are
says the unit: ``char`` gives every code point a class of its own, ``word`` tells white space from the rest, ``line`` ends a
unit after each line feed.  All choices depend on the seed and the document's id alone, so every run, and every retry of a
task, gives the same rows.  It is one map over the rows: nothing is shuffled, and a task holds one text and its arrays.

Cases with a defined result: a null text counts as empty and is ``plain``; a null id chooses as an empty number does;
repeated ids and repeated rows are treated row by row; bytes that are no UTF-8 count as one code point each and come back
unchanged; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import small_batches

#: Marks before the prefix, the suffix and the middle.
MARKS = ("<P>", "<S>", "<M>")
#: Of a hundred documents, so many are transformed, and of a hundred of these so many have the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20
#: Code points that Unicode counts as white space.
_SPACE = np.array([*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], "<u4")
COLUMNS = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def code_points(raw: bytes) -> np.ndarray:
    """The code points of UTF-8 bytes; a byte that belongs to none is a surrogate of its own."""
    return np.frombuffer(raw.decode(errors="surrogateescape").encode("utf-32-le", "surrogatepass"), "<u4")


def utf8(points: np.ndarray) -> bytes:
    return points.tobytes().decode("utf-32-le", "surrogatepass").encode(errors="surrogateescape")


def boundaries(points: np.ndarray, unit: str) -> np.ndarray:
    """Where units begin, and the end of the last: boundary k is the end of the first k units."""
    n = len(points)
    if unit == "char":
        classes = np.arange(n)
    elif unit == "word":
        classes = np.isin(points, _SPACE)
    else:
        classes = np.cumsum(points == 10) - (points == 10)
    inner = np.flatnonzero(classes[1:] != classes[:-1]) + 1
    return np.concatenate(([0], inner, [n] if n else [])).astype(np.int64)


def _draws(seed: int, doc_id: int | None) -> np.ndarray:
    """Four unsigned 32-bit numbers for a document."""
    return np.frombuffer(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest(), ">u4", 4)


def _checked(marks: Sequence[str]) -> tuple[str, str, str]:
    prefix, suffix, middle = marks
    firsts = {m[:1] for m in marks}
    if len(set(marks)) < 3 or "" in firsts or any(c in m[1:] for m in marks for c in firsts) or any(a != b and b.startswith(a) for a in marks for b in marks):
        raise ValueError("three marks are needed that can't overlap: the character that begins one may not occur further on in any, and none may begin another")
    return prefix, suffix, middle


def transform(
    docs: DataFrame, unit: str = "char", seed: int = 1, marks: Sequence[str] = MARKS, transformed: int = TRANSFORMED, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """Per row: doc_id, n units, form, code points of prefix and middle (null if plain), and the output text.

    form: ``plain`` (the text as it is), ``psm`` (prefix, suffix, middle) or ``spm`` (suffix, prefix, middle), each part
    behind its mark.  A text that holds a mark stays plain, so that ``restored`` is exact.
    """
    if unit not in ("char", "word", "line"):
        raise ValueError("unit is one of char, word, line")
    p, s, m = (np.frombuffer(x.encode("utf-32-le"), "<u4") for x in _checked(marks))
    found = [x.encode() for x in marks]
    small_batches(docs.sparkSession)
    names = [f.split()[0] for f in COLUMNS.split(", ")]

    def one(doc_id: int | None, raw: bytes) -> tuple[int, str, int | None, int | None, bytes]:
        points = code_points(raw)
        at = boundaries(points, unit)
        n = len(at) - 1
        h1, h2, h3, h4 = _draws(seed, doc_id).tolist()
        if not n or h3 % 100 >= transformed or any(x in raw for x in found):
            return n, "plain", None, None, raw
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = int(at[low]), int(at[high])
        prefix, middle, suffix = points[:a], points[a:b], points[b:]
        parts, form = ((s, suffix, p, prefix, m, middle), "spm") if h4 % 100 < suffix_first else ((p, prefix, s, suffix, m, middle), "psm")
        return n, form, a, b - a, utf8(np.concatenate(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for c in X.chunks(batch.column(1)):
                n, form, prefix, middle, output = zip(*(one(ids[c.lo + k], X.text_of(c, k)) for k in range(len(c))), strict=True)
                offs = np.concatenate(([0], np.cumsum([len(x) for x in output])))
                kind, width = (pa.large_string(), np.int64) if offs[-1] >= 1 << 31 else (pa.string(), np.int32)
                text = pa.Array.from_buffers(kind, len(output), [None, pa.py_buffer(offs.astype(width)), pa.py_buffer(b"".join(output))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[c.lo : c.hi], pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), text], names
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, COLUMNS)


def restored(form: Column, output: Column, marks: Sequence[str] = MARKS) -> Column:
    """The text that an output of ``transform`` was made of."""
    prefix, suffix, middle = _checked(marks)

    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, end, 1), start, -1)

    last = F.substring_index(output, middle, -1)
    return (
        F.when(form == "psm", F.concat(between(prefix, suffix), last, between(suffix, middle)))
        .when(form == "spm", F.concat(between(prefix, middle), last, between(suffix, prefix)))
        .otherwise(output)
    )


def digest(transformed: DataFrame, marks: Sequence[str] = MARKS) -> DataFrame:
    """The rows of ``transform`` with output_sha256 and restored_sha256 in place of the texts."""
    back = restored(F.col("form"), F.col("output"), marks)
    return transformed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
