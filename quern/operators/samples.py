"""Repeatable samples that equal a sequential shuffle's, without shuffling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .ranges import running_sums

# Fixed values of the generator: its step, and the bits that are set before each product.
STEP, FIRST, SECOND = 0x6D2B79F5, 1, 61
WORD = 1 << 32
#: Swaps that are followed on the driver, whatever the table's size.
LOCAL = 1 << 16


def drawn(seed: int, number: int) -> int:
    """The draw of a number, from 1 on, as a whole number below 2^32."""
    t = (seed + number * STEP) % WORD
    t = (t ^ t >> 15) * (t | FIRST) % WORD
    t ^= (t + (t ^ t >> 7) * (t | SECOND)) % WORD
    return t ^ t >> 14


def draws(seed: int, number: Column) -> Column:
    """``drawn`` of a column: a draw depends on its number alone, so any task can make any of them."""
    low = lambda c: c.bitwiseAND(WORD - 1)

    def times(a: Column, b: Column) -> Column:  # in halves, which no product overflows
        return low(a * b.bitwiseAND(0xFFFF) + F.shiftleft((a * F.shiftright(b, 16)).bitwiseAND(0xFFFF), 16))

    t = low(F.lit(seed) + low(number) * STEP)
    t = times(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(F.lit(FIRST).cast("long")))
    t = t.bitwiseXOR(low(t + times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(SECOND).cast("long")))))
    return t.bitwiseXOR(F.shiftright(t, 14))


def shuffled_places(spark: SparkSession, n: int, size: int, seed: int, used: int = 0, local: int = LOCAL) -> list[int]:
    """Which of n items a shuffle brings to the first ``size`` places; used: draws that were made before.

    The shuffle swaps each place i, from the last down to 1, with a random one up to i.  Seen backwards, what ends at a place below i
    is moved by the swap of i only if that draws the place it is at, and is at i then.  So each of the sample's items is followed by the
    least later i that draws its place; all of them at once are one pass over the draws, with no data, and passes grow with log n.
    """
    size = min(size, n)
    at = list(range(size))
    where = {p: p for p in at}
    near = max(size, min(n, local))
    for i in range(1, near):
        j = int(drawn(seed, used + n - i) / WORD * (i + 1))
        if i != j:
            a, b = where.pop(i, None), where.pop(j, None)
            if a is not None:
                where[j] = a
            if b is not None:
                where[i] = b
    for place, k in where.items():
        at[k] = place
    moving = [(k, place, near - 1) for k, place in enumerate(at)]
    i = F.col("id")
    while moving and near < n:
        swaps = spark.range(min(t for _, _, t in moving) + 1, n).select(i, F.floor(draws(seed, F.lit(used + n) - i) / F.lit(float(WORD)) * (i + 1)).alias("place"))
        now = F.broadcast(spark.createDataFrame(moving, "item int, place long, after long"))  # as many rows as the sample
        moved = swaps.join(now, "place").where(i > F.col("after")).groupBy("item").agg(F.min("id").alias("id")).collect()
        for r in moved:
            at[r["item"]] = r["id"]
        moving = [(r["item"], r["id"], r["id"]) for r in moved]
    return at


def seeded_sample(rows: DataFrame, order: list[str], size: int, seed: int, keep: Callable[[DataFrame], DataFrame], used: int = 0, local: int = LOCAL) -> DataFrame:
    """The first ``size`` rows, with place (from 0), of the shuffle of the rows in an order in which no two are equal."""
    ranked = keep(running_sums(rows.withColumn("__all", F.lit(0)), "__all", order, F.lit(1), keep))
    places = shuffled_places(rows.sparkSession, ranked.count(), size, seed, used, local)
    chosen = rows.sparkSession.createDataFrame([(p + 1, k) for k, p in enumerate(places)], "spent long, place int")
    return ranked.join(F.broadcast(chosen), "spent").select(*rows.columns, "place")
