"""Language identification by interpolated Kneser-Ney character models, one for each language.

Letters are lower-cased and numbered (the ``OWN`` most frequent ones of the sample, and all others by a hash of the code point), runs of anything
else are one boundary.  Each language's model holds, for every order up to ``ORDER``, its discounted n-gram probabilities and its
contexts' interpolation weights in arrays sorted by the n-gram's hash.  A whole text is scored by every model; the least
cross-entropy per character wins.  The share of the winner is a softmax whose steepness is calibrated on texts left out of
the models, and so are the cross-entropies beyond which a text is rejected as being in none of the languages.

Bound of the sample: ``PER_LANGUAGE`` labelled documents of each language, by a hash of their id.

Cases with a defined result: null and empty texts, and texts without a letter, are ``und`` with score 0 and rejected; ties
go to the language that sorts first; a null id is not held out; without any labelled row everything is ``und``; rows are
scored one by one, so repeated ids keep their own results; further columns are ignored, or kept by ``keep_identified``.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._store import small_batches

ORDER = 4
PER_LANGUAGE = 400
_BITS = 10
SYMBOLS = 1 << _BITS  # 0 boundary, then the most frequent letters, then the rest by hash
OWN = 511
#: N-grams that a worker remembers before it starts anew; only speed depends on it.
REMEMBERED = 2_000_000
#: Bits for a character that a text may have beyond the worst 0.1 % of the texts left out of the models.
MARGIN = 2.0


def held_out(doc_id: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point, its lower-case form if it is a letter, else 0."""
    out = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if unicodedata.category(x)[0] == "L":
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def _code_points(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw.decode().encode("utf-32-le"), np.uint32)


def _hash(order: int, code: np.ndarray) -> np.ndarray:
    return X.mix(code.astype(X.U) ^ X.U(order << 56))


@dataclass
class _Table:
    """Values by n-gram, in an array sorted by hash."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(order: int, code: np.ndarray, values: np.ndarray) -> _Table:
        h = _hash(order, code)
        by = np.argsort(h)
        return _Table(h[by], values[by])

    def get(self, order: int, code: np.ndarray, default: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(code), default)
        h = _hash(order, code)
        at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return np.where(self.keys[at] == h, self.values[at], default)


def _grams(seq: np.ndarray, order: int) -> np.ndarray:
    """Codes of the n-grams that end at each symbol after the padding."""
    code = np.zeros(len(seq), np.uint64)
    for k in range(order):
        shifted = seq[: len(seq) - k] if k else seq
        code[k:] |= shifted.astype(np.uint64) << X.U(_BITS * k)
    return code


class KneserNey:
    """Interpolated, one discount for each order; orders below the highest count distinct left neighbours."""

    def __init__(self, sequences: list[np.ndarray]) -> None:
        pad = np.zeros(ORDER - 1, np.uint16)
        codes = [_grams(np.concatenate((pad, s)), ORDER)[ORDER - 1 :] for s in sequences]
        gram, count = np.unique(np.concatenate(codes), return_counts=True)
        self.prob: list[_Table] = []
        self.rest: list[_Table] = []
        for n in range(ORDER, 0, -1):
            n1, n2 = (count == 1).sum(), (count == 2).sum()
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            context = gram >> X.U(_BITS)
            names, where = np.unique(context, return_inverse=True)
            total, kinds = np.bincount(where, count), np.bincount(where)
            self.prob.append(_Table.of(n, gram, np.maximum(count - discount, 0) / total[where]))
            self.rest.append(_Table.of(n, names, discount * kinds / total))
            # the next lower order: how many symbols precede each shorter n-gram
            gram, count = np.unique(gram & X.U((1 << (_BITS * (n - 1))) - 1), return_counts=True)

    def probability(self, code: np.ndarray) -> np.ndarray:
        p = np.full(len(code), 1 / SYMBOLS)
        for n in range(1, ORDER + 1):
            own = code & X.U((1 << (_BITS * n)) - 1)
            k = ORDER - n
            p = self.prob[k].get(n, own, 0.0) + self.rest[k].get(n, own >> X.U(_BITS), 1.0) * p
        return p


@dataclass
class Identifier:
    languages: list[str]
    letters: np.ndarray  # the numbered letters, as code points
    models: list[KneserNey]
    limit: np.ndarray  # by language: bits for a character beyond which a text is rejected
    steep: float = 1.0
    table: np.ndarray | None = field(default=None, repr=False)

    def number(self) -> None:
        """Prepares scoring in this process."""
        letter = _letters()
        other = OWN + 1 + (X.mix(np.arange(0x110000, dtype=X.U)) % X.U(SYMBOLS - OWN - 1)).astype(np.uint16)
        other[self.letters] = np.arange(1, 1 + len(self.letters))
        self.table = np.where(letter > 0, other[letter], 0).astype(np.uint16)
        self.forget()

    def forget(self) -> None:
        self.known = np.zeros(0, np.int64)  # n-grams met so far, sorted
        self.bits = np.zeros((0, len(self.languages)), np.float32)

    def symbols(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the texts that ``first`` cuts, boundaries at the head and repeated ones dropped."""
        s = self.table[points]
        before = np.zeros(len(s), np.uint16)
        before[1:] = s[:-1]
        before[first[:-1][np.diff(first) > 0]] = 0
        keep = (s > 0) | (before > 0)
        return s[keep], np.concatenate(([0], np.cumsum(keep)))[first]

    def score(self, c: X.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Bits for a character under each model, and the number of symbols, of each text of the chunk."""
        out = np.zeros((len(c), len(self.languages)))
        if not len(c.buf) or not self.languages:
            return out, np.zeros(len(c), np.int64)
        chars = np.concatenate(([0], np.cumsum((c.buf & 0xC0) != 0x80)))
        s, first = self.symbols(_code_points(c.buf.tobytes()), chars[c.offs])
        n = np.diff(first)
        if not len(s):
            return out, n
        inside = np.arange(len(s)) - np.repeat(first[:-1], n)
        code = s.astype(np.int64)
        for k in range(1, ORDER):
            prior = np.zeros(len(s), np.int64)
            prior[k:] = s[: len(s) - k]
            prior[inside < k] = 0
            code |= prior << (_BITS * k)
        grams, inverse = np.unique(code, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.forget()
        pos = np.searchsorted(self.known, grams)
        inside = pos < len(self.known)
        fresh = ~inside
        fresh[inside] = self.known[pos[inside]] != grams[inside]
        if fresh.any():
            new = np.column_stack([-np.log2(m.probability(grams[fresh].astype(X.U))) for m in self.models]).astype(np.float32)
            self.known = np.insert(self.known, pos[fresh], grams[fresh])
            self.bits = np.insert(self.bits, pos[fresh], new, axis=0)
            pos = np.searchsorted(self.known, grams)
        at = pos[inverse]
        some = n > 0
        for k in range(len(self.languages)):
            out[some, k] = np.add.reduceat(self.bits[at, k].astype(np.float64), first[:-1][some]) / n[some]
        return out, n

    def decide(self, bits: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the best language (-1: no letter), its share, and whether the text is rejected."""
        if not self.languages:
            return np.full(len(n), -1), np.zeros(len(n)), np.ones(len(n), bool)
        best = bits.argmin(axis=1)
        low = bits[np.arange(len(n)), best]
        weight = np.exp2(-self.steep * np.sqrt(n)[:, None] * (bits - low[:, None]))
        share = 1 / weight.sum(axis=1)
        none = n == 0
        return np.where(none, -1, best), np.where(none, 0.0, share), none | (low - 6 / np.sqrt(np.maximum(n, 1)) > self.limit[best])


def _whole(texts: list[str]) -> X.Chunk:
    return next(X.chunks(pa.array(texts, pa.large_string()), 1 << 60))


def fit(docs: DataFrame, folds: int = 4, fold: int = 2) -> Identifier:
    """Fitted on text and language of the rows outside the held-out fold."""
    rows = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id", folds, fold))
    ids = rows.select("doc_id", "lang", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)).alias("h"))
    # one row for each language, which also has a model in memory; three times the wanted rows, by hash, are then ranked
    sizes = ids.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    near = ids.join(F.broadcast(sizes), "lang").where(F.col("h") * F.col("rows") <= 3_000_000 * PER_LANGUAGE)
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    picked = near.withColumn("nth", nth).where(F.col("nth") <= PER_LANGUAGE).select("doc_id", "lang")
    sample: dict[str, list[str]] = {}
    # PER_LANGUAGE ids of each language: always small
    for r in rows.join(F.broadcast(picked), ["doc_id", "lang"]).orderBy("lang", F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).toLocalIterator():
        sample.setdefault(r.lang, []).append(r.text)
    languages = sorted(sample)
    if not languages:
        return Identifier([], np.zeros(0, np.int64), [], np.zeros(0))
    letter = _letters()
    seen = np.zeros(0x110000, np.int64)
    for texts in sample.values():
        for t in texts:
            seen += np.bincount(letter[_code_points(t.encode())], minlength=0x110000) if t else 0
    seen[0] = 0
    top = np.argsort(-seen, kind="stable")[:OWN]
    found = Identifier(languages, top[seen[top] > 0], [], np.full(len(languages), np.inf))
    found.number()
    check: list[tuple[int, str]] = []
    for k, lang in enumerate(languages):
        c = _whole([t for i, t in enumerate(sample[lang]) if i % 4 or len(sample[lang]) < 8])
        chars = np.concatenate(([0], np.cumsum((c.buf & 0xC0) != 0x80)))
        s, first = found.symbols(_code_points(c.buf.tobytes()), chars[c.offs])
        found.models.append(KneserNey(np.split(s, first[1:-1])))
        check += [(k, t) for i, t in enumerate(sample[lang]) if i % 4 == 0]
    bits, n = found.score(_whole([t for _, t in check]))
    truth = np.array([k for k, _ in check])
    some = n > 0
    bits, n, truth = bits[some], n[some], truth[some]
    best = -np.inf
    for steep in 2.0 ** np.arange(-4, 6):
        found.steep = steep
        z = -steep * np.sqrt(n)[:, None] * (bits - bits.min(axis=1, keepdims=True)) * np.log(2)
        likely = (z[np.arange(len(n)), truth] - np.logaddexp.reduce(z, axis=1)).clip(-10).sum()
        if likely > best:
            best, kept = likely, steep
    found.steep = kept
    own = bits[np.arange(len(n)), truth] - 6 / np.sqrt(n)
    found.limit = np.array([np.quantile(own[truth == k], 0.999) + MARGIN if (truth == k).any() else np.inf for k in range(len(languages))])
    found.table, found.known, found.bits = None, None, None
    return found


def predict(docs: DataFrame, identifier: Identifier, folds: int = 4, fold: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (0 to 1), rejected."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", folds, fold).alias("held_out"), F.col("text").alias("text"))
    names = np.array([*identifier.languages, "und"], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if identifier.table is None:
            identifier.number()
        for b in batches:
            parts = [identifier.decide(*identifier.score(c)) for c in X.chunks(b.column(2))]
            lang, share, out = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0) for i in range(3))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(names[lang.astype(int)], pa.string()), pa.array(share.astype(float)), pa.array(out.astype(bool))],
                ["doc_id", "held_out", "lang_pred", "score", "rejected"],
            )

    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, identifier: Identifier) -> DataFrame:
    """The documents, all columns, whose text is not rejected."""
    small_batches(docs.sparkSession)

    def known(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        if identifier.table is None:
            identifier.number()
        for texts in batches:
            parts = [identifier.decide(*identifier.score(c))[2] for c in X.chunks(pa.array(texts, pa.string(), from_pandas=True))]
            yield pd.Series(~np.concatenate(parts) if parts else np.zeros(0, bool))

    return docs.where(F.pandas_udf(known, "boolean")("text"))
