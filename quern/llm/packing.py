"""Packing: documents' tokens in sequences of a fixed capacity with as little padding as can be.

Each document's ids (and an end id) are cut into full windows and what remains.  Which remainders share a sequence follows
from how many there are of each length, whatever the documents: the counts, one row for each length up to the capacity,
are all that the driver sees.  ``plan`` fills windows by minimum bin slack: the longest remainder that is left, and for the
rest of the window the multiset of lengths whose sum comes closest, by subset-sum dynamic programming over a bitset with
binary-split counts, tracked back to counts of lengths.  A pattern is used as often as the counts allow, so the number of
patterns grows with the logarithm of the corpus only.  Where slack stays, a further remainder is cut to fill it, its rest
going back to the counts; the very last sequence is cut into powers of two, which need no padding.

Documents are then dealt to the plan's places by their rank within their length.  Ranks come without a sort or a window over
documents: each task numbers its pieces by length as it writes them, and the counts of tasks before it are added, which
is a join on (task, length).  Checksums are taken as pieces are written; ids are fetched again only for pieces that the plan cuts.

Cases with a defined result: null and empty texts are the end id alone; null and repeated ids and repeated rows are pieces of
their own; a text of any length is cut into as many windows as it fills; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import _text as X
from ._pieces import read_model
from ._store import small_batches, written
from ._tokens import word_model

CAPACITY, END = 4096, 2
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_ITEM = "doc_id long, doc_tokens long, start long, length long, crc long, task long, rank long, ids binary"


def fill(counts: dict[int, int], target: int) -> dict[int, int]:
    """How many of each length to take, of those there are, for a sum as close to the target as can be without passing it."""
    reached, steps = 1, []
    mask = (1 << (target + 1)) - 1
    for size in sorted((s for s, n in counts.items() if n and s <= target), reverse=True):
        left, share = min(counts[size], target // size), 1
        while left and not reached >> target & 1:
            share = min(share, left)
            steps.append((size, share, reached))
            reached |= reached << size * share & mask
            left -= share
            share *= 2
        if reached >> target & 1:
            break
    at, out = reached.bit_length() - 1, defaultdict(int)
    for size, share, before in reversed(steps):
        if not before >> at & 1:
            out[size] += share
            at -= size * share
    return dict(out)


class Plan:
    """Where the pieces of each length go.

    ``rows``: (length, first rank, end rank, start in the piece, tokens, first number in the pattern's run, copies in a
    sequence, first sequence, offset of the first copy) - the piece of rank r is number ``run + r - first`` of its
    pattern's run, which has so many copies in each sequence.
    """

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        self.capacity, self.sequences = capacity, 0
        self.rows: list[tuple[int, ...]] = []
        self._left = {s: n for s, n in counts.items() if n}
        self._held: dict[int, list[tuple[int, int, int, int]]] = {s: [(s, 0, n, 0)] for s, n in self._left.items()}
        while self._left:
            self._step()

    def _taken(self, size: int, n: int) -> list[tuple[int, int, int, int]]:
        """n pieces of a length, as ranges of ranks (of which length, first, end, start in the piece)."""
        self._left[size] -= n
        if not self._left[size]:
            del self._left[size]
        out = []
        while n:
            of, lo, hi, start = self._held[size].pop()
            if hi - lo > n:
                self._held[size].append((of, lo + n, hi, start))
                hi = lo + n
            out.append((of, lo, hi, start))
            n -= hi - lo
        return out

    def _put(self, ranges: list[tuple[int, int, int, int]], tokens: int, copies: int, offset: int, sequence: int) -> None:
        run = 0
        for of, lo, hi, start in ranges:
            self.rows.append((of, lo, hi, start, tokens, run, copies, sequence, offset))
            run += hi - lo

    def _step(self) -> None:
        top = max(self._left)
        rest = dict(self._left)
        rest[top] -= 1
        need = fill(rest, self.capacity - top)
        need[top] = need.get(top, 0) + 1
        slack = self.capacity - sum(s * n for s, n in need.items())
        cut = max((s for s, n in self._left.items() if n > need.get(s, 0)), default=0) if slack else 0
        wanted = dict(need)
        if cut:
            wanted[cut] = wanted.get(cut, 0) + 1
        times = min(self._left[s] // n for s, n in wanted.items())
        if slack and not cut:
            self._last(need)
            return
        offset = 0
        for size, n in sorted(need.items(), reverse=True):
            self._put(self._taken(size, n * times), size, n, offset, self.sequences)
            offset += size * n
        if cut:
            ranges = self._taken(cut, times)
            self._put(ranges, slack, 1, offset, self.sequences)
            if cut > slack:
                self._held.setdefault(cut - slack, []).extend((of, lo, hi, start + slack) for of, lo, hi, start in ranges)
                self._left[cut - slack] = self._left.get(cut - slack, 0) + times
        self.sequences += times

    def _last(self, need: dict[int, int]) -> None:
        """All that is left, less than a window, in sequences whose lengths are powers of two."""
        total = sum(s * n for s, n in need.items())
        room = [1 << k for k in range(total.bit_length() - 1, -1, -1) if total >> k & 1]
        used = 0
        for size, n in sorted(need.items(), reverse=True):
            for of, lo, hi, start in self._taken(size, n):
                for rank in range(lo, hi):
                    at = start
                    while at < start + size:
                        step = min(start + size - at, room[0] - used)
                        self.rows.append((of, rank, rank + 1, at, step, 0, 1, self.sequences, used))
                        at, used = at + step, used + step
                        if used == room[0]:
                            room.pop(0)
                            self.sequences, used = self.sequences + 1, 0

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys (length, first rank) of ranges of ranks that are treated alike, where the rows of each begin, and the rows by range."""
        by: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for row in self.rows:
            by[row[0]].append(row)
        keys, first, rows = [], [0], []
        for of in sorted(by):
            starts: dict[int, list[tuple[int, ...]]] = defaultdict(list)
            edges = sorted({x for r in by[of] for x in r[1:3]})
            place = {x: k for k, x in enumerate(edges)}
            for r in by[of]:
                for k in range(place[r[1]], place[r[2]]):
                    starts[edges[k]].append(r)
            for x in edges[:-1]:
                keys.append((of, x))
                rows += sorted(starts[x], key=lambda r: r[3])
                first.append(len(rows))
        return np.array(keys, np.int64).reshape(-1, 2), np.array(first, np.int64), np.array(rows, np.int64).reshape(-1, 9)

    def cut_lengths(self) -> list[int]:
        """Lengths of which some pieces are cut."""
        return sorted({r[0] for r in self.rows if r[4] != r[0]})


def tokens(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """The documents' ids in windows of the capacity and what remains, as a table, with each piece's rank in its task and length."""
    spec = read_model(path)
    small_batches(docs.sparkSession)
    names = [f.split()[0] for f in _ITEM.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = word_model(spec)
        width = "<u2" if max(m.vocabulary, end + 1) <= 1 << 16 else "<u4"
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            for c in X.chunks(b.column(1)):
                ids, first = m.encode(c)
                ids = np.insert(ids, first[1:], end)
                first = first + np.arange(len(first))
                n = np.diff(first)
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * capacity
                length = np.minimum(n[doc] - start, capacity)
                order = np.argsort(length, kind="stable")
                place = np.arange(len(order)) - np.searchsorted(length[order], length[order])
                rank = np.empty(len(order), np.int64)
                rank[order] = place + seen[length[order]]
                seen += np.bincount(length, minlength=capacity + 1)
                at = first[doc] + start
                wide, narrow = ids.astype("<u4").tobytes(), ids.astype(width).tobytes()
                size = np.dtype(width).itemsize
                spans = list(zip(at.tolist(), (at + length).tolist(), strict=True))
                crc = [zlib.crc32(wide[4 * x : 4 * y]) for x, y in spans]
                raw = [narrow[size * x : size * y] for x, y in spans]
                own = b.column(0)[c.lo : c.hi].take(pa.array(doc))
                flat = [pa.array(x.astype(np.int64)) for x in (n[doc], start, length)]
                yield pa.RecordBatch.from_arrays(
                    [own, *flat, pa.array(crc, pa.int64()), pa.array(np.full(len(doc), task, np.int64)), pa.array(rank), pa.array(raw, pa.binary())], names
                )

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return written(own.mapInArrow(run, _ITEM), "tokens")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """Per piece: doc_id, start in its document, length, CRC-32 of its ids, the document's tokens, its sequence and the offset there.

    ``path`` is of a model of the tokenizers library; documents are encoded without special tokens and followed by ``end``.
    ``with_ids`` adds the ids, from which the sequences can be written.
    """
    items = tokens(docs, path, capacity, end)
    counts = items.groupBy("task", "length").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    places = counts.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))
    # one row for each length up to the capacity
    plan = Plan({r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}, capacity)
    keys, first, rows = plan.table()
    key = keys[:, 0] << 44 | keys[:, 1]  # a rank is below 2^44
    names = [*(f.split()[0] for f in PIECE.split(", ")), "cut_from", "cut", "task", "of", "rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            doc_tokens, start, length, crc, task, rank, at = (b.column(k).to_numpy(zero_copy_only=False) for k in range(1, 8))
            row = np.searchsorted(key, length << 44 | at, "right") - 1
            n = first[row + 1] - first[row]
            item = np.repeat(np.arange(len(row)), n)
            _, lo, _, inner, size, run, copies, sequence, offset = rows[X.ragged(first[row], n)].T
            number = run + at[item] - lo
            whole = size == length[item]
            out = (start[item] + inner, size, np.where(whole, crc[item], 0), doc_tokens[item], sequence + number // copies, offset + number % copies * size, inner)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(item)), *map(pa.array, out), pa.array(~whole), *(pa.array(x[item]) for x in (task, length, rank))], names
            )

    ranked = items.join(places, ["task", "length"]).select("doc_id", "doc_tokens", "start", "length", "crc", "task", "rank", (F.col("rank") + F.col("before")).alias("at"))
    dealt = ranked.mapInArrow(place, f"{PIECE}, cut_from long, cut boolean, task long, of long, rank long")
    wanted = [f.split()[0] for f in PIECE.split(", ")]
    cut = plan.cut_lengths()
    if not with_ids and not cut:
        return dealt.select(wanted)
    source = items.select("task", F.col("length").alias("of"), "rank", F.col("ids").alias("source"))
    if not with_ids:
        few = docs.sparkSession.createDataFrame([(x,) for x in cut], "of long")  # at most one row for each length
        source = source.join(F.broadcast(few), "of", "left_semi")
    vocabulary = word_model(read_model(path)).vocabulary
    width = "<u2" if max(vocabulary, end + 1) <= 1 << 16 else "<u4"

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = np.dtype(width).itemsize
        for b in batches:
            spans = zip(b.column("source").to_pylist(), b.column("cut_from").to_pylist(), b.column("length").to_pylist(), strict=True)
            ids = [np.frombuffer(raw[size * x : size * (x + n)], width).astype("<u4") for raw, x, n in spans]
            cols = [b.column(w) if w != "ids_crc32" else pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()) for w in wanted]
            if with_ids:
                cut_at = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(cut_at), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, [*wanted, *["ids"][: int(with_ids)]])

    fetched = (dealt if with_ids else dealt.where("cut")).join(source, ["task", "of", "rank"]).mapInArrow(fetch, PIECE + (", ids array<int>" if with_ids else ""))
    return fetched if with_ids else dealt.where("NOT cut").select(wanted).unionByName(fetched)
