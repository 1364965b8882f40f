"""Quality rules as robust multivariate outliers.

Each document's statistics are transformed towards symmetry and compared with the minimum-covariance-determinant estimate
of its language and source: concentration steps, each an aggregation over all rows, repeat "mean and covariance of
the half of the group that is nearest" until no group's log-determinant falls by more than ``SETTLED`` any more (``STEPS``
steps at most).  The steps are taken from ``STARTS`` starts at once, the rows around the medians and small subsets by a hash, and a group keeps the estimate
of the least determinant.  A document is rejected when its squared robust Mahalanobis distance is beyond a chi-square quantile, scaled
by the median distance of the group, after one reweighting step over the rows inside that limit.  Only the nearer half of the group decides on the scale, so up to half of its rows may be
outliers.

The estimates are rows of a table, one for each group, which is broadcast when its groups are counted and few (``BROADCAST_GROUPS``); no
group's rows meet in one task, and nothing but numbers of rows reaches the driver.  Groups of fewer than ``LEAST`` rows share one group of all such rows.

Cases with a defined result: null and empty texts have zero counts and fail the base rule; null languages and sources are
groups of their own; rows that fail the base rule take no part in the estimates; where a statistic is constant in a group
its variance has a floor (``FLOOR``); repeated rows count as often as they stand; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _text as X
from ._store import small_batches, written

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The transformed statistics, in order.
FEATURES = ("f0", "f1", "f2", "f3", "f4")
MIN_WORDS = 50
REPEAT_PERCENT = 50
LEAST = 30
STEPS = 20
STARTS = 4
#: Steps from all starts, before the best one goes on alone.
TRIAL_STEPS = 2
#: Rows that a start by hash has on average.
SUBSET = 15
#: Groups of some 500 bytes each: at most some 10 MB are broadcast.
BROADCAST_GROUPS = 20_000
SETTLED = 1e-3
#: Bands of squared distance for each e-fold, and the lowest one, which takes all nearer rows too.
BANDS = 16
LOWEST = -32
FLOOR = (0.05, 0.02, 0.03, 0.05, 0.05)
#: Chi-square quantiles of 5 degrees of freedom: at 1e-6, and the median.
CHI2 = 35.89
MEDIAN = 4.351
#: The upper quartile of the standard normal distribution.
QUARTILE = 0.6745
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _statistics(c: X.Chunk) -> dict[str, np.ndarray]:
    s, e, first = X.word_bounds(c.buf, c.offs)
    words = X.bytes_hash(c.buf, s, e)
    n = np.diff(first)
    text = np.repeat(np.arange(len(c)), n)
    inside = np.concatenate(([0], np.cumsum(~X.SPACE[c.buf] & ((c.buf & 0xC0) != 0x80))))
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[c.buf])))

    # lines with a word, by hash; all but the first of equal ones in a text are duplicates
    breaks = np.flatnonzero(c.buf == 10)
    begin = np.unique(np.concatenate((c.offs[:-1], breaks + 1)))
    begin = begin[begin < len(c.buf)]
    line_text = np.searchsorted(c.offs, begin, "right") - 1
    stop = np.minimum(np.append(begin[1:], len(c.buf)), c.offs[line_text + 1])
    closed = (stop > begin) & (c.buf[np.maximum(stop - 1, 0)] == 10)
    stop = stop - closed
    full = np.searchsorted(s, stop) > np.searchsorted(s, begin)
    key = X.bytes_hash(c.buf, begin[full], stop[full]) ^ X.mix(line_text[full].astype(X.U))
    line_text = line_text[full]
    _, at = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[at] = False
    dup_lines = np.bincount(line_text[again], minlength=len(c))

    # words in three-word windows that occur twice or more in their text
    covered = np.zeros(len(s) + 3, bool)
    if len(s) >= 3:
        m = len(s) - 2
        ok = text[:m] == text[2:]
        at = np.flatnonzero(ok)
        grams = X.span_hash(X.item_sums(words), at, at + 3) ^ X.mix(text[at].astype(X.U))
        order = np.argsort(grams)
        g = grams[order]
        twice = np.zeros(len(g), bool)
        same = g[1:] == g[:-1]
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        for k in range(3):
            covered[hit + k] = True
    rep = np.concatenate(([0], np.cumsum(covered[: len(s)])))
    return {
        "n_words": n,
        "word_chars": np.diff(inside[c.offs]),
        "n_symbols": np.diff(symbols[c.offs]),
        "n_dup_lines": dup_lines,
        "n_repeat_words": np.diff(rep[first]),
    }


def _mapper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for c in X.chunks(b.column(3)):
            got = _statistics(c)
            yield pa.RecordBatch.from_arrays([*(b.column(k)[c.lo : c.hi] for k in range(3)), *(pa.array(got[k].astype(np.int64)) for k in STATS)], ["doc_id", "lang", "source", *STATS])


def statistics(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, lang, source and the five counts."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(c).cast("string").alias(c) for c in ("lang", "source")), F.col("text").alias("text"))
    return own.mapInArrow(_mapper, "doc_id long, lang string, source string, " + ", ".join(f"{x} long" for x in STATS))


def _features(df: DataFrame) -> DataFrame:
    words = F.greatest("n_words", F.lit(1))
    return df.withColumns(
        {
            "f0": F.log1p("n_words"),
            "f1": F.log(F.greatest("word_chars", F.lit(1)) / words),
            "f2": F.log1p(20 * F.col("n_symbols") / words),
            "f3": F.log1p(20 * F.col("n_dup_lines") / words),
            "f4": F.log1p(5 * F.col("n_repeat_words") / words),
        }
    )


_K = range(len(FEATURES))
#: The features and their products, whose means give centre and covariance.  Long expressions are SQL: one call to the JVM each.
_TERMS = {f"m{i}": FEATURES[i] for i in _K} | {f"s{i}_{j}": f"{FEATURES[i]} * {FEATURES[j]}" for i in _K for j in _K if j >= i}
_D2 = " + ".join(f"{1 if i == j else 2} * inverse[{i * len(FEATURES) + j}] * (f{i} - centre[{i}]) * (f{j} - centre[{j}])" for i in _K for j in _K if j >= i)
_SHAPE = "grp string, start int, centre array<double>, inverse array<double>, logdet double, settled boolean"


def _moments(df: DataFrame) -> DataFrame:
    """Means of the rows of each group and start up to second order, combined before the shuffle."""
    return df.groupBy("grp", "start").agg(F.lit(None).cast("double").alias("was"), *(F.expr(f"avg({c}) {name}") for name, c in _TERMS.items()))


def _shapes(moments: DataFrame) -> DataFrame:
    """Centre, inverse covariance and its log-determinant, and if that settled: one row in, one row out."""
    k = len(FEATURES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            out = []
            for r in p.itertuples(index=False):
                m = np.array([getattr(r, f"m{i}") for i in range(k)])
                s = np.zeros((k, k))
                for i in range(k):
                    for j in range(i, k):
                        s[i, j] = s[j, i] = getattr(r, f"s{i}_{j}") - m[i] * m[j]
                s += np.diag(np.square(FLOOR))
                logdet = np.linalg.slogdet(s)[1]
                settled = bool(pd.notna(r.was) and r.was - logdet <= SETTLED)
                out.append((r.grp, r.start, m.tolist(), np.linalg.inv(s).ravel().tolist(), logdet, settled))
            yield pd.DataFrame(out, columns=["grp", "start", "centre", "inverse", "logdet", "settled"])

    return moments.mapInPandas(run, _SHAPE)


def _distance(df: DataFrame, shapes: DataFrame, how: str = "inner") -> DataFrame:
    """df with start, logdet and d2, the squared Mahalanobis distance to each of its group's estimates."""
    return df.join(shapes, "grp", how).withColumn("d2", F.expr(_D2)).drop("centre", "inverse", "settled")


def _step(good: DataFrame, shapes: DataFrame) -> DataFrame:
    """A concentration step: the moments of the nearer half of the rows, for each group and start in shapes.

    Rows are summed by band of distance, so that a few hundred rows for each group and start are shuffled; of the band
    in which the half ends, the share that completes it counts.
    """
    banded = _distance(good, shapes).withColumn("band", F.expr(f"greatest({LOWEST}, ceil({BANDS} * ln(d2)))"))
    sums = banded.groupBy("grp", "start", "band").agg(F.expr("min(logdet) was"), F.expr("count(1) rows"), *(F.expr(f"sum({c}) {x}") for x, c in _TERMS.items()))
    each = "partition by grp, start"
    before = f"sum(rows) over ({each} order by band rows unbounded preceding) - rows"
    share = f"least(1.0D, greatest(0.0D, (sum(rows) over ({each}) / 2 - ({before})) / rows))"
    taken = sums.withColumn("share", F.expr(share)).groupBy("grp", "start")
    return taken.agg(F.expr("min(was) was"), *(F.expr(f"sum(share * {x}) / sum(share * rows) {x}") for x in _TERMS))


def _starts(good: DataFrame, side: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The first estimates: start 0 from medians and quartiles, the others from a few rows by hash."""
    quartiles = (F.expr(f"percentile_approx({f}, array(0.25, 0.5, 0.75), 1000) q{i}") for i, f in enumerate(FEATURES))
    middle = written(good.groupBy("grp").agg(F.expr("count(1) rows"), *quartiles), "medians")
    # the narrower side of the median, which outliers on one side don't widen
    spread = [f"greatest({FLOOR[i]}D, least(q{i}[1] - q{i}[0], q{i}[2] - q{i}[1]) / {QUARTILE}D)" for i in _K]
    diagonal = ", ".join(f"1 / pow({spread[i]}, 2)" if i == j else "0.0D" for i in _K for j in _K)
    medians = ", ".join(f"q{i}[1]" for i in _K)
    first = middle.selectExpr("grp", "0 start", f"array({medians}) centre", f"array({diagonal}) inverse", "0.0D logdet", "false settled")
    numbered = good.join(side(middle.select("grp", "rows")), "grp").withColumn("start", F.expr(f"explode(sequence(1, {STARTS - 1}))"))
    drawn = numbered.where(F.pmod(F.xxhash64("doc_id", "start", *FEATURES), F.col("rows")) < SUBSET)
    return first.unionByName(_shapes(_moments(drawn)))


def _concentrated(good: DataFrame, side: Callable[[DataFrame], DataFrame], steps: int) -> DataFrame:
    """A shape for each group: its estimate of the least determinant."""
    shapes = written(_starts(good, side), "shapes")
    for _ in range(TRIAL_STEPS):
        shapes = written(_shapes(_step(good, side(shapes))), "shapes")
    best = shapes.groupBy("grp").agg(F.expr("min_by(struct(start, centre, inverse, logdet, false settled), struct(logdet, start)) best"))
    shapes = written(best.select("grp", "best.*"), "shapes")
    for _ in range(steps - TRIAL_STEPS):
        moving, still = shapes.where("not settled"), shapes.where("settled")
        shapes = written(still.unionByName(_shapes(_step(good, side(moving)))), "shapes")
        if shapes.where("not settled").isEmpty():
            break
    return shapes


def _limit(far: DataFrame) -> DataFrame:
    """grp and the largest squared distance that is kept: the chi-square quantile, widened where the group's median is larger."""
    return far.groupBy("grp").agg((CHI2 * F.greatest(F.lit(1.0), F.percentile_approx("d2", 0.5, 1000) / MEDIAN)).alias("limit"))


def judge(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, distance (null without an estimate) and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    stats = statistics(docs).withColumn("base_failed", failed)
    named = F.concat_ws("\x1f", F.coalesce("lang", F.lit("\0")), F.coalesce("source", F.lit("\0")))
    rows = written(_features(stats.withColumn("own", named)), "statistics")
    sized = written(rows.where("not base_failed").groupBy("own").agg(F.count(F.lit(1)).alias("size")), "sizes")
    few = sized.count() * STARTS <= BROADCAST_GROUPS
    side = F.broadcast if few else (lambda df: df)
    grouped = rows.join(side(sized), "own", "left").withColumn("grp", F.when(F.col("size") >= LEAST, F.col("own")).otherwise(F.lit("small")))
    good = written(grouped.where("not base_failed").select("doc_id", "grp", *FEATURES), "good")
    shapes = _concentrated(good, side, steps)
    # the half nearest to a centre has a smaller covariance than the whole: scale so that the median is the chi-square one
    far = _distance(good, side(shapes))
    inside = far.join(side(_limit(far)), "grp").where("d2 <= limit")
    # reweighting: the covariance of all rows inside, so that their ordinary tails stay
    shapes = side(written(_shapes(_moments(inside)), "shapes"))
    limit = written(_limit(_distance(good, shapes)), "limits")
    judged = _distance(grouped, shapes, "left").join(side(limit), "grp", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("d2") <= F.col("limit"), F.lit(True))
    return judged.select("doc_id", *STATS, "base_failed", kept.alias("kept"), F.sqrt("d2").alias("distance"))
