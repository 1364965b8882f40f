"""Alignment of two tokenizers: groups of tokens that spell the same bytes, links between overlapping tokens, and their counts.

Both tokenizers cut a text at some places for certain, before a single space in the main, whatever stands around.  Texts are
segments between such places, and every distinct segment of a block of documents is tokenised and aligned once; a document
is the sequence of its segments' numbers.  The alignment itself is relational: segments' tokens are rows (posexplode) in turn of
the byte at which they begin, and tokens of both sides that begin at the same byte of the same segment meet as neighbours, which
is the equi-join of either side's ends without a second shuffle of tokens.  A group begins where both begin.  Links need no join
of all tokens of a group: two tokens overlap in one range of bytes, no token of either side begins inside it, and so links and
distinct begins are the same rows; the tokens that cover one are the last ones that began, whose places follow from the row's.

Counts of linked id pairs are summed over segments, weighted by how often a segment occurs, and joined to segments' links: the
most frequent ``FREQUENT`` pairs at most by broadcast, rarer ones, none of which has a large share, by a shuffle.

Nothing moves but sums of pairs: segments are a table in buckets by part of a block, aligned ones and documents are tables in
buckets by block, so that joins and groups are local.  A task sorts the tokens of some parts, or holds the aligned
segments of some blocks (of ``BLOCK`` bytes of text, or a single longer document) and the documents' segments.

Cases with a defined result: texts that are null, empty, no UTF-8, or that hold U+2581 (which the piece model reads as a space)
have no tokens: zeros and no groups; null and repeated ids and repeated rows are documents of their own; a long text
without any space is one segment; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _text as X
from ._pieces import Model, read_model
from ._store import bucketed, small_batches, written
from ._tokens import Memo, flattened, loaded

#: Bytes of text after which a task begins a new block.
BLOCK = 16 << 20
#: Parts in which the segments of a block are aligned.
PARTS = 4
#: Id pairs that are broadcast with their counts.
FREQUENT = 500_000
_ROW = "part long, block long, segment int, n long, n_a int, codes array<int>, begins array<int>, turns array<int>, doc long, doc_id long, segments array<int>"
#: Segments that are encoded as one text.
TOGETHER = 100
#: First bytes of the characters beyond ASCII that may be white space.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: ASCII characters that are neither white space nor controls.
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
_MARK = "▁".encode()


class Pair:
    """A byte-level BPE tokenizer (A) and a piece model with byte fallback (B), applied to segments; B's ids follow A's in ``codes``."""

    def __init__(self, byte_bpe: bytes, pieces: bytes) -> None:
        spec = json.loads(byte_bpe)
        pre = spec["pre_tokenizer"] or {}
        self.a = loaded(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = Model(pieces)
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or sum(len(t) == 1 for t in vocabulary) < 256:
            raise ValueError("the first tokenizer has to be byte-level BPE without normaliser and prefix space")
        if not self.b.by_pre_token or sum(self.b.sp.is_byte(k) for k in range(self.b.sp.get_piece_size())) != 256:
            raise ValueError("the second model has to keep texts as they are, cut at spaces, and fall back to bytes")
        self.first = max(vocabulary.values()) + 1
        self.length = np.zeros(self.first + len(self.b.piece_len), np.int64)
        for token, k in vocabulary.items():
            self.length[k] = len(token)  # each character of a byte-level token stands for one byte
        self.length[self.first :] = self.b.piece_len
        self.memo = Memo(self._encode)

    def _encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes of segments, each of which begins with a space or with a text."""
        raw = buf.tobytes()
        second = np.append(buf, 0)[starts + 1]
        clean = (buf[starts] == 32) & (ends - starts > 1) & (second > 32) & ~_WIDE[second] & _SOLID[buf[ends - 1]]
        both = []
        # segments that can't be told from the middle of a text are encoded together
        k = np.flatnonzero(clean)
        edges = np.cumsum((ends - starts)[k])
        # a few at a time, since either library takes longer for a character of a longer text
        few = np.arange(0, len(k), TOGETHER)
        at = np.append(np.concatenate(([0], edges))[few], edges[-1:]).tolist()
        joined = b"".join([raw[x:y] for x, y in zip(starts[k].tolist(), ends[k].tolist(), strict=True)])
        texts = [joined[x:y].decode() for x, y in zip(at[:-1], at[1:], strict=True)]
        a = [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]
        b = self.b.sp.encode([t[1:] for t in texts], num_threads=1) if texts else []
        for ids, first in ((a, 0), (b, self.first)):
            codes = flattened(ids)[0] + first
            at = np.cumsum(self.length[codes])
            last = np.searchsorted(at, edges) + 1
            if len(edges) and not np.array_equal(at[last - 1], edges):
                raise ValueError("a token crosses the place between two segments")
            both.append((codes, np.diff(last, prepend=0)))
        rest = np.flatnonzero(~clean)
        texts = [raw[x:y].decode() for x, y in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)]
        others = (
            flattened([e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)]),
            flattened([[y + self.first for y in x] for x in (self.b.sp.encode([t[1:] for t in texts], num_threads=1) if texts else [])]),
        )
        flat, n, at = [], [], []
        base = 0
        for (codes, sizes), (more, more_sizes) in zip(both, others, strict=True):
            own = np.concatenate((sizes, more_sizes))
            flat.append(np.concatenate((codes, more)))
            at.append(base + np.cumsum(own) - own)
            n.append(own)
            base += len(flat[-1])
        back = np.argsort(np.concatenate((k, rest)))
        at_both, n_both = np.column_stack(at)[back].ravel(), np.column_stack(n)[back].ravel()
        return np.concatenate(flat)[X.ragged(at_both, n_both)], n_both.reshape(-1, 2).sum(1)

    def cut(self, c: X.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """The memory's slot of each segment of the chunk's texts, and each text's first one."""
        raw = c.buf.tobytes()
        sound = ~c.null & (np.diff(c.offs) > 0)
        try:
            whole = _MARK not in raw and raw.decode() is not None
        except UnicodeDecodeError:
            whole = False
        if not whole:
            for k in np.flatnonzero(sound).tolist():
                try:
                    sound[k] = "▁" not in X.text_of(c, k).decode()
                except UnicodeDecodeError:
                    sound[k] = False
        sizes = np.where(sound, np.diff(c.offs) + 1, 0)
        offs = np.concatenate(([0], np.cumsum(sizes)))
        buf = np.full(int(offs[-1]), 32, np.uint8)
        buf[X.ragged(offs[:-1][sound] + 1, sizes[sound] - 1)] = c.buf[X.ragged(c.offs[:-1][sound], sizes[sound] - 1)]
        # before a space that a solid ASCII character precedes and no white space follows
        space = np.flatnonzero((buf[1:-1] == 32) & _SOLID[buf[:-2]] & (_SOLID[buf[2:]] | (buf[2:] >= 128) & ~_WIDE[buf[2:]])) + 1
        head = np.zeros(len(buf), bool)
        head[space] = True
        head[offs[:-1][sound]] = True
        starts = np.flatnonzero(head)
        return self.memo.slots(buf, starts, np.append(starts[1:], len(buf))) if len(starts) else np.zeros(0, np.int64), np.searchsorted(starts, offs)


@lru_cache(maxsize=2)
def _load(digest: str, byte_bpe: bytes, pieces: bytes) -> Pair:
    return Pair(byte_bpe, pieces)


def pair(byte_bpe: bytes, pieces: bytes) -> Pair:
    """The worker's own copy of both models."""
    return _load(hashlib.sha256(byte_bpe + pieces).hexdigest(), byte_bpe, pieces)


class _Block:
    """The distinct segments of a block in order of appearance, with their codes and how often they occur."""

    def __init__(self, number: int, generation: int) -> None:
        self.number, self.generation, self.bytes = number, generation, 0
        self.own = np.full(0, -1, np.int64)  # by slot of the memory
        self.often = np.zeros(0, np.int64)
        self.codes: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []

    def add(self, memo: Memo, slots: np.ndarray) -> np.ndarray:
        """The numbers of segments, new ones included."""
        if len(self.own) < len(memo.count):
            self.own = np.concatenate((self.own, np.full(len(memo.count) - len(self.own), -1, np.int64)))
        distinct, first = np.unique(slots, return_index=True)
        new = distinct[np.argsort(first)]
        new = new[self.own[new] < 0]
        self.own[new] = len(self.often) + np.arange(len(new))
        self.codes.append(memo.ids(new).astype(np.int32))
        self.sizes.append(memo.count[new])
        numbers = self.own[slots]
        self.often = np.concatenate((self.often, np.zeros(len(new), np.int64))) + np.bincount(numbers, minlength=len(self.often) + len(new))
        return numbers


@dataclass
class Alignment:
    """``segments``: block, segment, n (occurrences), n_a, n_b, n_groups, n_links, groups (text), links (ids of A and B in one number).

    ``documents``: block, doc, doc_id and segments, their numbers in turn.
    """

    segments: DataFrame
    documents: DataFrame


def _session(spark: SparkSession) -> SparkSession:
    """A session with the caller's settings in which joins and groups use a partitioning by block that is there already."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and own.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    own.conf.set("spark.sql.execution.useObjectHashAggregateExec", "false")
    return own


def _tokenised(docs: DataFrame, byte_bpe: bytes, pieces: bytes, block: int) -> DataFrame:
    """Rows of documents (doc, doc_id, segments) and, after each block's, of its segments, a few parts of them.

    A segment has n (occurrences), n_a (tokens of A), codes of A's tokens and then of B's, the byte at which each of them begins,
    and turns: their places in both by the byte at which they begin, with A's before B's there.
    """
    small_batches(docs.sparkSession)
    names = [f.split()[0] for f in _ROW.split(", ")]

    def lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), pa.array(flat.astype(np.int32)))

    def closed(b: _Block, length: np.ndarray, first: int) -> Iterator[pa.RecordBatch]:
        sizes, codes = np.concatenate([np.zeros(0, np.int64), *b.sizes]), np.concatenate([np.zeros(0, np.int32), *b.codes])
        at = np.concatenate(([0], np.cumsum(sizes)))
        b.sizes.clear()
        b.codes.clear()
        for lo in range(0, len(sizes), 20_000):
            hi = min(lo + 20_000, len(sizes))
            k = hi - lo
            none = [pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int32()))]
            some, long = codes[at[lo] : at[hi]], length[codes[at[lo] : at[hi]]]
            spelled = np.add.reduceat(long, at[lo:hi] - at[lo]) // 2  # by A and by B
            bytes_before = 2 * (np.cumsum(spelled) - spelled)
            begins = np.cumsum(long) - long - np.repeat(bytes_before, sizes[lo:hi]) - np.where(some < first, 0, np.repeat(spelled, sizes[lo:hi]))
            turns = np.argsort((np.repeat(bytes_before, sizes[lo:hi]) + begins) * 2 + (some >= first), kind="stable") - np.repeat(at[lo:hi] - at[lo], sizes[lo:hi])
            n_a = np.add.reduceat((some < first).astype(np.int32), at[lo:hi] - at[lo])
            segment = np.arange(lo, hi, dtype=np.int32)
            own = [pa.array(x) for x in (np.full(k, b.number * PARTS) + segment % PARTS, np.full(k, b.number), segment, b.often[lo:hi], n_a.astype(np.int32))]
            own += [lists(x, sizes[lo:hi]) for x in (some, begins, turns)]
            yield pa.RecordBatch.from_arrays([*own, *none], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = pair(byte_bpe, pieces)
        task = TaskContext.get().partitionId()
        blocks = docs_seen = 0
        now = _Block(task << 24, m.memo.generation)
        for batch in batches:
            for c in X.chunks(batch.column(1)):
                slots, first = m.cut(c)
                if now.generation != m.memo.generation or now.bytes and now.bytes + len(c.buf) > block:
                    yield from closed(now, m.length, m.first)
                    blocks += 1
                    now = _Block((task << 24) + blocks, m.memo.generation)
                now.bytes += len(c.buf)
                numbers, k = now.add(m.memo, slots), len(c)
                none = [pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), *[pa.nulls(k, pa.list_(pa.int32()))] * 3]
                doc = (task << 40) + docs_seen + np.arange(k)
                docs_seen += k
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.full(k, now.number))] * 2, *none, pa.array(doc), batch.column(0)[c.lo : c.hi], lists(numbers, np.diff(first))], names
                )
        yield from closed(now, m.length, m.first)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, _ROW)


def align(docs: DataFrame, byte_bpe_path: str, pieces_path: str, block: int = BLOCK) -> Alignment:
    """Segments of all documents with their groups and links; A is applied to a space and the text, as B does by itself."""
    byte_bpe, pieces = read_model(byte_bpe_path), read_model(pieces_path)
    m = pair(byte_bpe, pieces)
    spark = _session(docs.sparkSession)
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # keys are few, and some share a bucket
    made = bucketed(_tokenised(docs, byte_bpe, pieces, block), "tokenised", buckets, "part", spark)
    documents = made.where("doc IS NOT NULL").select(F.col("part").alias("block"), "doc", "doc_id", "segments")
    own = ["segment", "part"]
    of_a = F.col("k") < F.col("n_a")
    neighbour = F.get("turns", F.col("pos") + F.when(of_a, 1).otherwise(-1))
    # a token's own number and its turn say how many tokens of the other side began before it, and so which is the last of them
    other = F.get("codes", F.col("n_a") + F.col("pos") - F.col("k") - 1)
    tokens = (
        made.where("segment IS NOT NULL")
        .select(*own, "n", "n_a", "codes", "begins", "turns", F.posexplode("turns").alias("pos", "k"))
        .select(*own, "n", "pos", of_a.alias("a"), F.get("codes", F.col("k")).alias("code"), other.alias("other"),
            F.get("begins", F.col("k")).eqNullSafe(F.get("begins", neighbour)).alias("meets"))
        .sortWithinPartitions(*own, "pos")
    )
    # the last row that begins at a byte links both tokens that cover it from there
    a_id, b_id = F.when(F.col("a"), F.col("code")).otherwise(F.col("other")), F.when(F.col("a"), F.col("other")).otherwise(F.col("code")) - m.first
    link = F.when(~(F.col("a") & F.col("meets")), F.shiftleft(a_id.cast("long"), 32) + b_id)
    # the first token of its side in its group begins with a semicolon
    start = F.when(F.col("pos") < 2, "").when(F.col("meets"), ";").otherwise(",")
    sides = [F.when(F.col("a"), F.concat(start, a_id.cast("string"))).alias("a"), F.when(~F.col("a"), F.concat(start, b_id.cast("string"))).alias("b")]
    segments = (
        # columns of their own, since what stands inside collect_list isn't compiled
        tokens.select(*own, "n", link.alias("link"), *sides)
        .groupBy(*own)
        .agg(F.first("n").alias("n"), F.collect_list("link").alias("links"), F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
        .select(
            F.floor(F.col("part") / PARTS).cast("long").alias("block"), "segment", "n", F.size("a").alias("n_a"), F.size("b").alias("n_b"), F.size("links").alias("n_links"),
            # each token begins a link, but two that begin together, as a group does, begin the same one
            (F.size("a") + F.size("b") - F.size("links")).alias("n_groups"), "links", F.array_join("a", "").alias("a"), F.array_join("b", "").alias("b"),
        )
        .withColumn("groups", F.when(F.col("n_groups") == 1, F.concat("a", F.lit("|"), "b")).otherwise(
            F.array_join(F.zip_with(F.split("a", ";"), F.split("b", ";"), lambda x, y: F.concat(x, F.lit("|"), y)), ";")))
        .drop("a", "b")
    )
    return Alignment(bucketed(segments, "aligned", buckets, "block", spark), documents)


def pair_counts(found: Alignment) -> DataFrame:
    """Per pair of ids that some link holds: link (both in one number), a_id, b_id, n (links), and best: no id of A has more links with b_id."""
    links = found.segments.select(F.explode("links").alias("link"), "n").groupBy("link").agg(F.sum("n").alias("n"))
    split = links.select("link", F.shiftright("link", 32).cast("int").alias("a_id"), F.col("link").bitwiseAND((1 << 32) - 1).cast("int").alias("b_id"), "n")
    counts = written(split, "pairs")
    most = counts.groupBy("b_id").agg(F.max("n").alias("most"))  # as many rows as B's vocabulary has
    return counts.join(F.broadcast(most), "b_id").select("link", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def summaries(found: Alignment, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """Per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, and its groups as text."""
    kept = written(counts.select("link", F.col("n").alias("count"), "best"), "counts")
    own = ["segment", "block"]
    rows, total = kept.agg(F.count("*"), F.sum("count")).first()
    least = 0 if rows <= frequent else -(-total // frequent)  # no more than so many pairs have a share of one in so many
    links = found.segments.select("block", "segment", F.explode("links").alias("link"))
    often = F.broadcast(kept.where(F.col("count") >= least))
    sums = [F.sum(F.col("best").cast("int")).alias("n_best"), F.sum("count").alias("count_sum")]
    scores = links.join(often, "link").groupBy(*own).agg(*sums)
    if least:
        rare = links.join(often, "link", "left_anti").join(kept.where(F.col("count") < least), "link").groupBy(*own).agg(*sums)
        scores = scores.unionByName(rare).groupBy(*own).agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    scored = found.segments.drop("links", "n", "n_groups").join(scores, own)
    summed = ["n_a", "n_b", "n_links", "n_best", "count_sum"]
    numbers = [*summed[:2], "n_groups", *summed[2:]]
    spelled = (
        found.documents.where(F.size("segments") > 0)
        .select("doc", "block", "doc_id", F.posexplode("segments").alias("pos", "segment"))
        .sortWithinPartitions("doc", "block")
        .join(scored.hint("shuffle_hash"), own)
        .groupBy("doc", "block")
        .agg(F.first("doc_id").alias("doc_id"), *(F.sum(x).alias(x) for x in summed), F.expr("listagg(groups, ';') WITHIN GROUP (ORDER BY pos)").alias("groups"))
        .withColumn("n_groups", F.col("n_a") + F.col("n_b") - F.col("n_links"))
    )
    none = found.documents.where(F.size("segments") == 0).select("doc_id", *(F.lit(0).cast("long").alias(x) for x in numbers), F.lit("").alias("groups"))
    return spelled.select("doc_id", *numbers, "groups").unionByName(none)


def digest(docs: DataFrame, byte_bpe_path: str, pieces_path: str) -> DataFrame:
    """``summaries`` with the SHA-256 of the groups' text in its place, empty without tokens."""
    found = align(docs, byte_bpe_path, pieces_path)
    out = summaries(found, pair_counts(found))
    return out.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")).drop("groups")
