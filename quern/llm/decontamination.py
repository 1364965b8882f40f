"""Benchmark decontamination: a prefix-filtered set join in DataFrame functions only.

A window is ``window`` consecutive words of a benchmark item (a shorter item is one window).  A document that holds a
window holds all its words, so the prefix that must be joined is one word, the rarest of the window in the corpus.  Each
occurrence of such a word in a document fixes where the window would begin; the length and position bounds discard those
that would reach over an end of the document, and the words of the rest are compared exactly.

The join key is the single word in lower case (fast in Spark): words that are equal after lower-casing A-Z have the same key, and
the final comparison lower-cases A-Z alone.  Rows of (document, place, word) are all that is joined; the benchmark is
broadcast when its windows are counted and few.  The places where a window may begin are written as a table, and only the
texts of documents that have one are fetched, by a broadcast of these documents when they are counted and few, and compared
once each.

Cases with a defined result: null and empty texts have no words and no hits; items without words never occur; rows of
documents that repeat an id, or have none, are judged each by its own text; items with a null item_id mark words but aren't
counted; an empty benchmark hits nothing; further columns are ignored here and kept by ``drop_contaminated``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import written

WINDOW = 10
#: Windows of about 100 bytes each: at most some 50 MB are broadcast.
BROADCAST_WINDOWS = 500_000
#: Documents with a candidate, of 16 bytes each, that are broadcast.
BROADCAST_DOCUMENTS = 1_000_000

_BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _words(text: Column) -> Column:
    """The words with their original case."""
    return F.array_remove(F.split(text, _BETWEEN), "")


def _windows(items: DataFrame, window: int) -> DataFrame:
    """item_id, length, win (the words, A-Z lower-cased, joined by spaces), keys (its words in lower case)."""
    n = F.size("words")
    return (
        items.select(F.col("item_id").cast("string").alias("item_id"), _words(F.col("text")).alias("words"))
        .where("size(words) > 0")
        .withColumn("length", F.least(n, F.lit(window)))
        .withColumn("start", F.explode(F.sequence(F.lit(1), n - F.col("length") + 1)))
        .withColumn("part", F.slice("words", F.col("start"), F.col("length")))
        .select("item_id", "length", _ascii_lower(F.array_join("part", " ")).alias("win"), F.transform("part", F.lower).alias("keys"))
        .distinct()
    )


def _texts(docs: DataFrame) -> DataFrame:
    """doc, tag (hash of the text, which tells rows of one id, or without one, apart) and text."""
    return docs.select(F.col("doc_id").alias("doc"), F.xxhash64("text").alias("tag"), F.col("text").alias("text")).where("text is not null")


def _same(left: DataFrame, right: DataFrame, doc: str = "doc", tag: str = "tag") -> Column:
    return left["doc"].eqNullSafe(right[doc]) & (left["tag"] == right[tag])


def candidates(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc, tag, and found: where windows may begin that hold their rarest word there (item_id, win, start from 0, length)."""
    wins = _windows(items, window)
    small = F.broadcast if wins.count() <= BROADCAST_WINDOWS else (lambda df: df)
    at = _texts(docs).withColumn("words", _words(F.col("text"))).withColumn("n", F.size("words")).select("doc", "tag", "n", F.posexplode("words").alias("pos", "word"))
    at = at.select("doc", "tag", "n", "pos", F.lower("word").alias("key"))
    vocabulary = wins.select(F.explode("keys").alias("key")).distinct()
    frequency = at.select("key").join(small(vocabulary), "key").groupBy("key").agg(F.count(F.lit(1)).alias("freq"))
    ranked = (
        wins.select("item_id", "length", "win", F.posexplode("keys").alias("offset", "key"))
        .join(frequency, "key")  # a window of which one word is nowhere in the corpus loses that word's row, and all others below
        .groupBy("item_id", "length", "win")
        .agg(F.count(F.lit(1)).alias("found"), F.min(F.struct("freq", "key", "offset")).alias("rarest"))
        .where("found = length")
        .select("item_id", "length", "win", F.col("rarest.key").alias("key"), F.col("rarest.offset").alias("offset"))
    )
    start = F.col("pos") - F.col("offset")
    met = at.join(small(ranked), "key").where((start >= 0) & (start + F.col("length") <= F.col("n")))
    return met.groupBy("doc", "tag").agg(F.collect_set(F.struct("item_id", "win", start.alias("start"), "length")).alias("found"))


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document with an occurrence of an item's window: doc, tag (hash of the text), n_hit (words inside any), items (sorted ids)."""
    table = written(candidates(docs, items, window), "candidates")
    own = table.select(F.col("doc").alias("d"), F.col("tag").alias("t"))
    texts = _texts(docs)
    few = texts.join(F.broadcast(own) if own.count() <= BROADCAST_DOCUMENTS else own, _same(texts, own, "d", "t"), "left_semi").distinct()
    few = few.select("doc", "tag", _words(F.col("text")).alias("words"))
    met = few.join(table.select(F.col("doc").alias("d"), F.col("tag").alias("t"), "found"), F.col("doc").eqNullSafe(F.col("d")) & (F.col("tag") == F.col("t")))
    spelled = lambda x: F.array_join(F.slice("words", x["start"] + 1, x["length"]), " ")
    true = met.select("doc", "tag", F.filter("found", lambda x: _ascii_lower(spelled(x)) == x["win"]).alias("found")).where("size(found) > 0")
    spans = F.array_distinct(F.transform("found", lambda x: F.struct(x["start"].alias("start"), x["length"].alias("length"))))
    words = F.array_distinct(F.flatten(F.transform(spans, lambda x: F.sequence(x["start"], x["start"] + x["length"] - 1))))
    ids = F.array_sort(F.array_distinct(F.array_compact(F.transform("found", lambda x: x["item_id"]))))
    return true.select("doc", "tag", F.size(words).cast("long").alias("n_hit"), ids.alias("items"))


def _joined(docs: DataFrame, items: DataFrame, window: int) -> DataFrame:
    per = hits(docs, items, window).select(F.col("doc").alias("__doc"), F.col("tag").alias("__tag"), F.col("n_hit").alias("__hit"), F.col("items").alias("__items"))
    keyed = docs.withColumn("__hash", F.xxhash64("text"))
    return keyed.join(per, keyed["doc_id"].eqNullSafe(per["__doc"]) & (keyed["__hash"] == per["__tag"]), "left").drop("__hash", "__doc", "__tag")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted item ids, comma-joined), contaminated."""
    own = docs.select("doc_id", "text", F.coalesce(F.size(_words(F.col("text"))), F.lit(0)).cast("long").alias("__n"))
    own = own.withColumn("__n", F.when(F.col("text").isNull(), 0).otherwise(F.col("__n")))
    hit = F.coalesce("__hit", F.lit(0)).cast("long")
    ids = F.coalesce("__items", F.array().cast("array<string>"))
    return _joined(own, items, window).select(
        "doc_id",
        F.col("__n").cast("long").alias("n_words"),
        hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, all columns, of which no word lies in an occurrence of an item's window."""
    return _joined(docs, items, window).where(F.col("__hit").isNull()).select(*[F.col(f"`{c}`") for c in docs.columns])
