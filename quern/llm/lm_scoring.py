"""Masked pseudo-likelihood: a bidirectional window network predicts every token from the tokens on both its sides.

A word is a class and its spelling within the class.  The corpus's ``WORDS`` most frequent words (counted over all documents) are
classes of their own; all other words belong to 32 shapes by length, capital, symbols and final mark, and are spelled by
a model of byte pairs that is counted over all of them.  The network (for each place around the token a table of
vectors, summed; one hidden layer; a softmax over groups of classes and one over the classes of a group) gives the class, with every token of every
text as a training target.  A document's score is the sum of the conditional log-probabilities of all its words.

Texts are dealt to two folds and to shards of about ``SHARD`` words by the hash of the text; a shard's texts are in the order of
that hash, so that the fit doesn't depend on how the table is partitioned.  Each shard trains a network in numpy from the same start, and a
fold's networks are averaged by Spark, in whole numbers.  A text is scored by the network of the other fold, which hasn't seen it.

What reaches the driver is bounded, whatever the corpus: the weights (about 250,000 numbers for each fold), the frequent words' hashes and
the 65,536 counts of byte pairs.

Cases with a defined result: null, empty and blank texts have 0 tokens, log_prob 0 and a null mean; a corpus without a word
leaves the initial weights; rows are scored one by one, so null and repeated ids keep their own; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import small_batches

SHAPES = 32
GROUP = 64  # classes of a group
GROUPS = 32
WORDS = GROUP * GROUPS - SHAPES
SIDE = 2
HIDDEN = 24
FOLDS = 2
SHARD = 2_000_000
RATE = 0.05
_CLASSES = GROUP * GROUPS
_EDGE = _CLASSES  # the token beyond either end of a text
_BLOCK = 1 << 16  # words that a shard gathers before it trains on them
_COUNTED = 2_000_000
_SCALE = 1 << 24

_SYMBOL = np.ones(256, bool)
_SYMBOL[48:58] = _SYMBOL[65:91] = _SYMBOL[97:123] = _SYMBOL[128:] = False
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[np.frombuffer(b".,;:!?", np.uint8)] = True
_SHAPES_OF = [(2 * SIDE, _CLASSES + 1, HIDDEN), (HIDDEN,), (HIDDEN, GROUPS), (GROUPS,), (GROUPS, HIDDEN, GROUP), (GROUPS, GROUP)]
_AT = np.cumsum([0, *(int(np.prod(s)) for s in _SHAPES_OF)])
_END = 32  # a space, which no word holds, ends its spelling


def _split(flat: np.ndarray) -> list[np.ndarray]:
    return [flat[a:b].reshape(s) for a, b, s in zip(_AT[:-1], _AT[1:], _SHAPES_OF, strict=True)]


def _initial(seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(0, 0.1 if k % 2 == 0 else 0, int(np.prod(s))) for k, s in enumerate(_SHAPES_OF)]).astype(np.float32)


def _softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(axis=1, keepdims=True)
    np.exp(z, out=z)
    z /= z.sum(axis=1, keepdims=True)
    return z


def _groups(tok: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Of each group that has some of the tokens, their places."""
    group = tok // GROUP
    order = np.argsort(group, kind="stable")
    cut = np.searchsorted(group[order], np.arange(GROUPS + 1))
    for g in np.flatnonzero(np.diff(cut)).tolist():
        yield g, order[cut[g] : cut[g + 1]]


@dataclass
class Network:
    common: np.ndarray  # sorted hashes of the frequent words
    flat: list[np.ndarray]  # of each fold
    spelling: np.ndarray  # of each byte, the log-probability of the next one in words that aren't frequent

    def tokens(self, c: X.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Classes of the chunk's words, where each text begins, the words' bounds, and the chunk in lower case."""
        low = X.LOWER[c.buf]
        s, e, first = X.word_bounds(c.buf, c.offs)
        if not len(s):
            return np.zeros(0, np.int64), first, s, e, low
        symbols = np.concatenate(([0], np.cumsum(_SYMBOL[c.buf] & ~_MARK[c.buf])))
        size = np.searchsorted(np.array([4, 7, 11]), e - s, "right")
        shape = size * 8 + 4 * _UPPER[c.buf[s]] + 2 * (symbols[e] > symbols[s]) + _MARK[c.buf[e - 1]]
        if not len(self.common):
            return WORDS + shape, first, s, e, low
        h = X.bytes_hash(low, s, e)
        at = np.minimum(np.searchsorted(self.common, h), len(self.common) - 1)
        return np.where(self.common[at] == h, at, WORDS + shape), first, s, e, low

    def spelled(self, tok: np.ndarray, s: np.ndarray, e: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Log-probability of each word's spelling within its class; 0 for frequent words."""
        out = np.zeros(len(tok))
        rare = np.flatnonzero(tok >= WORDS)
        if len(rare):
            begin, end = s[rare], e[rare]
            size = end - begin
            at = X.ragged(begin, size)
            inner = self.spelling[np.where(np.isin(at, begin, assume_unique=True), _END, low[at - 1]), low[at]]
            out[rare] = np.add.reduceat(inner.astype(np.float64), np.cumsum(size) - size) + self.spelling[low[end - 1], _END]
        return out

    @staticmethod
    def contexts(tok: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The tokens around those at the given places, a row for each place around."""
        text = np.searchsorted(first, at, "right") - 1
        lo, hi = first[text], first[text + 1]
        out = np.empty((2 * SIDE, len(at)), np.int64)
        for k, d in enumerate([*range(-SIDE, 0), *range(1, SIDE + 1)]):
            p = at + d
            out[k] = np.where((p >= lo) & (p < hi), tok[np.clip(p, 0, len(tok) - 1)], _EDGE)
        return out

    def log_prob(self, fold: int, tok: np.ndarray, first: np.ndarray, batch: int = 8192) -> np.ndarray:
        """Log-probability of each token's class, by the network of that fold."""
        table, b1, wg, bg, ww, bw = _split(self.flat[fold])
        out = np.empty(len(tok))
        for a in range(0, len(tok), batch):
            at = np.arange(a, min(a + batch, len(tok)))
            ctx = self.contexts(tok, first, at)
            h = np.tanh(b1 + sum(table[k][ctx[k]] for k in range(2 * SIDE)))
            own = tok[at]
            z = h @ wg + bg
            z -= z.max(axis=1, keepdims=True)
            got = z[np.arange(len(at)), own // GROUP] - np.log(np.exp(z).sum(axis=1))
            for g, rows in _groups(own):
                z = h[rows] @ ww[g] + bw[g]
                z -= z.max(axis=1, keepdims=True)
                got[rows] += z[np.arange(len(rows)), own[rows] % GROUP] - np.log(np.exp(z).sum(axis=1))
            out[at] = got
        return out

    @staticmethod
    def train(flat: np.ndarray, squares: np.ndarray, tok: np.ndarray, first: np.ndarray, batch: int = 4096) -> None:
        """One pass over all tokens (AdaGrad, in place)."""
        table, b1, wg, bg, ww, bw = weights = _split(flat)
        sums = _split(squares)
        grad = np.zeros_like(flat)
        d_table, d1, dwg, dbg, dww, dbw = _split(grad)
        for a in range(0, len(tok), batch):
            at = np.arange(a, min(a + batch, len(tok)))
            ctx, own, scale = Network.contexts(tok, first, at), tok[at], np.float32(1 / len(at))
            h = np.tanh(b1 + sum(table[k][ctx[k]] for k in range(2 * SIDE)))
            p = _softmax(h @ wg + bg)
            p[np.arange(len(at)), own // GROUP] -= 1
            p *= scale
            dwg[:], dbg[:] = h.T @ p, p.sum(axis=0)
            dh = p @ wg.T
            used = []
            for g, rows in _groups(own):
                p = _softmax(h[rows] @ ww[g] + bw[g])
                p[np.arange(len(rows)), own[rows] % GROUP] -= 1
                p *= scale
                dww[g], dbw[g] = h[rows].T @ p, p.sum(axis=0)
                dh[rows] += p @ ww[g].T
                used.append(g)
            dh *= 1 - h * h
            d1[:] = dh.sum(axis=0)
            for k in range(2 * SIDE):
                order = np.argsort(ctx[k], kind="stable")
                names, begin = np.unique(ctx[k][order], return_index=True)
                step = np.add.reduceat(dh[order], begin, axis=0)
                sums[0][k][names] += step * step
                table[k][names] -= RATE * step / (np.sqrt(sums[0][k][names]) + 1e-6)
            for w, s, g in zip(weights[1:4], sums[1:4], (d1, dwg, dbg), strict=True):
                s += g * g
                w -= RATE * g / (np.sqrt(s) + 1e-6)
            for w, s, g in ((ww, sums[4], dww), (bw, sums[5], dbw)):
                s[used] += g[used] * g[used]
                w[used] -= RATE * g[used] / (np.sqrt(s[used]) + 1e-6)


def _count_mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0

    def counted() -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n.astype(np.int64))], ["word", "n"])

    for b in batches:
        for c in X.chunks(b.column(0)):
            s, e, _ = X.word_bounds(c.buf, c.offs)
            if len(s):
                held.append(X.bytes_hash(X.LOWER[c.buf], s, e))
                size += len(s)
            if size > _COUNTED:
                yield counted()
                held, size = [], 0
    if held:
        yield counted()


def _pair_mapper(network: Network):
    """Counts of the byte pairs of words that aren't frequent: a row for each pair and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for c in X.chunks(b.column(0)):
                tok, _, s, e, low = network.tokens(c)
                rare = tok >= WORDS
                begin, end = s[rare], e[rare]
                at = X.ragged(begin, end - begin)
                before = np.where(np.isin(at, begin, assume_unique=True), _END, low[at - 1]).astype(np.int64)
                total += np.bincount(before << 8 | low[at], minlength=1 << 16)
                total += np.bincount(low[end - 1].astype(np.int64) << 8 | _END, minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["at", "n"])

    return run


def _train_mapper(network: Network):
    """Weights of the shards of a task, times their words, summed: a row for each weight and fold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, _AT[-1]), np.int64)
        words = np.zeros(FOLDS, np.int64)
        shard, flat, squares, n, held, size = None, None, None, 0, [], 0

        def block() -> None:
            nonlocal held, size
            if size:
                Network.train(flat, squares, np.concatenate(held), np.concatenate(([0], np.cumsum([len(x) for x in held]))))
            held, size = [], 0

        def close() -> None:
            if n:
                total[shard % FOLDS] += np.rint(flat.astype(np.float64) * _SCALE).astype(np.int64) * (n >> 10 or 1)
                words[shard % FOLDS] += n >> 10 or 1

        for b in batches:
            shards = b.column(0).to_numpy()
            for c in X.chunks(b.column(1)):
                tok, first, *_ = network.tokens(c)
                for k, (lo, hi) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    if shards[c.lo + k] != shard:
                        block()
                        close()
                        shard, flat, squares, n = int(shards[c.lo + k]), network.flat[0].copy(), np.full(_AT[-1], 1e-4, np.float32), 0
                    if hi > lo:
                        held.append(tok[lo:hi])
                        size += hi - lo
                        n += hi - lo
                        if size >= _BLOCK:
                            block()
        block()
        close()
        for f in np.flatnonzero(words).tolist():
            at = np.arange(_AT[-1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), f, np.int32)), pa.array(at), pa.array(total[f]), pa.array(np.full(len(at), words[f]))], ["fold", "at", "weight", "n"])

    return run


def _fold():
    return F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")


def fit(docs: DataFrame) -> Network:
    """Networks trained on all documents, one for each fold."""
    small_batches(docs.sparkSession)
    texts = docs.select(F.col("text").alias("text")).where("text is not null")
    counts = texts.mapInArrow(_count_mapper, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("n"), "word").limit(WORDS).toPandas()
    found = Network(np.sort(top["word"].to_numpy(np.int64).view(np.uint64)), [_initial()] * FOLDS, np.zeros((256, 256)))
    pairs = np.full((256, 256), 0.01)
    for r in texts.mapInArrow(_pair_mapper(found), "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():  # 65,536 rows at most
        pairs[r.at >> 8, r.at & 255] += r.n
    found.spelling = np.log(pairs / pairs.sum(axis=1, keepdims=True)).astype(np.float32)
    # about six bytes for a word
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = FOLDS * max(1, -(-size // (6 * SHARD * FOLDS)))
    dealt = texts.select(F.pmod(F.xxhash64("text"), F.lit(shards)).cast("long").alias("shard"), "text")
    sorted_ = dealt.repartition(shards, "shard").sortWithinPartitions("shard", F.xxhash64("text"))
    trained = sorted_.mapInArrow(_train_mapper(found), "fold int, at int, weight long, n long")
    mean = trained.groupBy("fold", "at").agg((F.sum(F.col("weight").cast("decimal(38,0)")) / F.sum("n")).cast("double").alias("w")).toPandas()  # as many rows as the networks have weights
    for f in range(FOLDS):
        own = mean[mean["fold"] == f]
        if len(own):
            found.flat[f] = np.zeros(_AT[-1], np.float32)
            found.flat[f][own["at"].to_numpy()] = (own["w"].to_numpy() / _SCALE).astype(np.float32)
    return found


def score(docs: DataFrame, network: Network) -> DataFrame:
    """Per row: doc_id, n_tokens, log_prob (natural logarithm, summed) and mean_log_prob."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, total = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows)
            folds = b.column(2).to_numpy()
            for f in range(FOLDS):
                rows = np.flatnonzero(folds == f)
                for c in X.chunks(b.column(1).take(pa.array(rows))):
                    tok, first, s, e, low = network.tokens(c)
                    each = network.log_prob((f + 1) % FOLDS, tok, first) + network.spelled(tok, s, e, low)
                    size = np.diff(first)
                    some = size > 0
                    n[rows[c.lo : c.hi]] = size
                    if some.any():
                        total[rows[c.lo : c.hi][some]] = np.add.reduceat(each, first[:-1][some])
            mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(total), mean], ["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.coalesce(_fold(), F.lit(0)).alias("fold"))
    return own.mapInArrow(run, "doc_id long, n_tokens long, log_prob double, mean_log_prob double")
