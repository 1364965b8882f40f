"""A training corpus from raw documents: five stages, each over all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from quern.llm import decontamination, language_id, ngram_join, sentencepiece_codec, substring_dedup
from quern.llm._store import delete, logged, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders of intermediate tables of the last stage that was called.
_made: list[str] = []


def _stage(f: Stage) -> Stage:
    """f, which first deletes the intermediate tables of the stage before: that stage's result has been written by now."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        delete(spark, _made)
        _made.clear()
        with logged(_made):
            return f(spark, docs, sf_dir)

    return run


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the known languages."""
    return language_id.keep_identified(docs, language_id.fit(docs))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document holds."""
    return substring_dedup.remove_spans(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids, and digests of the ids and of what they decode to, of each document that is left."""
    import public_tokenizers

    return sentencepiece_codec.digest(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language identification", _stage(identified)),
    ("n-gram Jaccard join", _stage(distinct)),
    ("substring dedup", _stage(without_repeats)),
    ("benchmark decontamination", _stage(uncontaminated)),
    ("SentencePiece encoding", _stage(encoded)),
]

#: Language identification and SentencePiece encoding can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
