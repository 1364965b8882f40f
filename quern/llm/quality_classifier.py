"""Quality by compression: which of two zstandard dictionaries, of good or of bad labelled text, explains a text better.

The texts of a bounded sample of labelled documents become two dictionaries; a text's score is the difference of its two
compressed sizes, normalised by its length, calibrated by a logistic regression on labelled texts that are in neither
dictionary.  The normalised size itself is the second input of the calibration, since the same difference means more in a
text that compresses well.  Whole texts are compressed; labels, language, source and id are never inputs of a score.

Bound of the sample: ``PER_CLASS`` documents of each label, by a hash of their id, and ``DICTIONARY`` bytes in a dictionary.

Cases with a defined result: null and empty texts get the score of an empty text (the share of label 1 in the sample); a
null id is not held out; a label without text, or other than 0 and 1, is ignored; without two classes of labels every
score is the share of label 1, or 0.5 without labels; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import small_batches

PER_CLASS = 1500
DICTIONARY = 1 << 16
THRESHOLD = 0.3


def held_out(doc_id: str, folds: int, fold: int):
    """crc32 of the id as text, modulo folds, is fold."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))


@dataclass
class Classifier:
    good: bytes
    bad: bytes
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def compressors(self):
        import zstandard as z

        made = []
        for content in (self.good, self.bad):
            d = z.ZstdCompressionDict(content)
            d.precompute_compress(level=3)
            made.append(z.ZstdCompressor(level=3, dict_data=d, write_checksum=False, write_content_size=False))
        return made

    def probability(self, x: np.ndarray) -> np.ndarray:
        z = np.clip(expand((x - self.mean) / self.scale) @ self.weights, -40, 40)
        return 1 / (1 + np.exp(-z))


def sizes(compressors, raw: bytes) -> tuple[float, float]:
    """Difference of the compressed sizes, bad minus good, and the smaller of them: both per byte of text."""
    g, b = (len(c.compress(raw)) for c in compressors)
    return (b - g) / len(raw), float(np.log(min(g, b) / len(raw)))


def expand(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -5, 5)
    return np.column_stack([np.ones(len(x)), x, x[:, 0] * x[:, 1], x**2])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    loss = lambda v: np.logaddexp(0, np.where(y > 0, -1, 1) * (x @ v)).sum() + ridge * (v @ v) / 2
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w += size * step
        if np.abs(step).max() * size < 1e-8:
            break
    return w


def _dictionary(texts: list[bytes]) -> bytes:
    """A trained dictionary; of texts too few or too short to train one, their own bytes."""
    import zstandard as z

    try:
        return z.train_dictionary(DICTIONARY, texts).as_bytes()
    except z.ZstdError:
        return b"\n".join(texts)[:DICTIONARY]


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, fold: int = 0) -> Classifier:
    """Fitted on the labelled rows outside the held-out fold."""
    lab = labels.where(F.col("quality").isin(0, 1)).where(~held_out("doc_id", folds, fold) & F.col("doc_id").isNotNull())
    picked = None
    share = lab.agg(F.avg("quality")).first()[0]
    for q in (0, 1):
        part = lab.where(F.col("quality") == q).select("doc_id", "quality").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(PER_CLASS)
        picked = part if picked is None else picked.unionByName(part)
    # at most 2 * PER_CLASS ids: always small
    texts = docs.select("doc_id", "text").where("text is not null and text <> ''").join(F.broadcast(picked), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(4 * PER_CLASS)
    rows = [(r.quality, r.text.encode()) for r in texts.toLocalIterator()]
    by = {q: [t for k, t in rows if k == q] for q in (0, 1)}
    prior = 0.5 if share is None else float(share)
    if min(len(v) for v in by.values()) < 4:
        return Classifier(b"", b"", np.zeros(0), np.zeros(2), np.ones(2), prior)
    content = {}
    left = []
    for q, texts_q in by.items():
        content[q] = _dictionary(texts_q[::2])
        left += [(q, t) for t in texts_q[1::2]]
    found = Classifier(content[1], content[0], np.zeros(0), np.zeros(2), np.ones(2), prior)
    comp = found.compressors()
    x, y = np.array([sizes(comp, t) for _, t in left]), np.array([q for q, _ in left], float)
    found.mean, found.scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    found.weights = _logistic(expand((x - found.mean) / found.scale), y)
    # the sample has as many bad as good texts; the score is for the share there is
    n1, n0 = y.sum(), len(y) - y.sum()
    if n1 and n0 and 0 < prior < 1:
        found.weights[0] += np.log(prior / (1 - prior)) - np.log(n1 / n0)
    return found


def score(docs: DataFrame, classifier: Classifier, folds: int = 5, fold: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold)."""
    small_batches(docs.sparkSession)
    names = ["doc_id", "held_out", "score", "predicted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp = classifier.compressors() if len(classifier.weights) else None
        for b in batches:
            out = np.full(b.num_rows, classifier.prior)
            at, x = [], []
            if comp:
                for k, t in enumerate(b.column(2)):
                    if raw := (t.as_py() or "").encode():
                        at.append(k)
                        x.append(sizes(comp, raw))
            if at:
                out[at] = classifier.probability(np.array(x))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out), pa.array((out >= threshold).astype(np.int32))], names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out("doc_id", folds, fold).alias("held_out"), F.col("text").alias("text"))
    return own.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
