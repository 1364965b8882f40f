"""SentencePiece models applied to whole columns: every distinct pre-token of a worker is encoded once.

A pre-token is a run of spaces with what follows it up to the next space or line feed, or a line feed with what follows
it.  In models whose pieces hold a space mark only at their head and no line feed, no merge crosses such a boundary, so
the pieces of a text are those of its pre-tokens in order.  ``Model`` verifies this for the model it loads; a model
for which it doesn't hold is applied to whole texts instead.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

from . import _text as X

MARK = "▁"
#: Distinct pre-tokens that a worker remembers before it starts anew; only speed depends on it.
REMEMBERED = 1_500_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    v = s = 0
    while True:
        c = b[i]
        i += 1
        v |= (c & 127) << s
        if c < 128:
            return v, i
        s += 7


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a serialised protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = _varint(b, i)
        else:
            n, i = (8, i) if kind == 1 else (4, i) if kind == 5 else _varint(b, i)
            v, i = b[i : i + n], i + n
        yield key >> 3, v


class CharMap:
    """The compiled character map of a model: a double-array trie from byte strings to their normal forms.

    ``normalise`` takes at each position the longest key of the trie that the text continues with, or else one character,
    and records for each byte of the result the byte of the source it stems from.
    """

    def __init__(self, blob: bytes) -> None:
        self.units = np.zeros(0, np.uint32)
        self.forms = b""
        if blob:
            n = int.from_bytes(blob[:4], "little")
            self.units = np.frombuffer(blob[4 : 4 + n], "<u4")
            self.forms = blob[4 + n :]

    def longest(self, raw: bytes, i: int) -> tuple[int, bytes] | None:
        """Length and normal form of the longest key at raw[i:]."""
        if not len(self.units):
            return None
        best, at = None, 0
        unit = int(self.units[0])
        at ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
        for k in range(i, len(raw)):
            at ^= raw[k]
            if at >= len(self.units):
                break
            unit = int(self.units[at])
            if unit & ((1 << 31) | 0xFF) != raw[k]:
                break
            at ^= (unit >> 10) << ((unit & (1 << 9)) >> 6)
            if unit >> 8 & 1:
                start = int(self.units[at]) & ((1 << 31) - 1)
                best = (k + 1 - i, self.forms[start : self.forms.index(b"\0", start)])
        return best

    def normalise(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normal form with a space for every space mark, and the source offset of each of its bytes and its end."""
        out, align, i = bytearray(), [], 0
        while i < len(raw):
            got = self.longest(raw, i)
            if got is None:
                size = 1 if raw[i] < 0x80 else 2 if raw[i] < 0xE0 else 3 if raw[i] < 0xF0 else 4
                got = size, raw[i : i + size]
            form = got[1].replace(MARK.encode(), b" ")
            out += form
            align += [i] * len(form)
            i += got[0]
        return bytes(out), np.array([*align, len(raw)], np.int64)


class Model:
    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        norm, pieces, kinds = {1: b"", 2: b"", 3: 1, 4: 1, 5: 1}, [], []
        for f, v in _fields(proto):
            if f == 1:
                x = dict(_fields(v))
                pieces.append(x.get(1, b"").decode())
                kinds.append(x.get(3, 1))
            elif f == 3:
                norm |= dict(_fields(v))
        self.char_map = CharMap(norm[2])
        normal = [p for p, k in zip(pieces, kinds, strict=True) if k == 1]
        inner = re.compile(f"[^{MARK}]{MARK}")
        self.by_pre_token = (
            not norm[2] and norm[3] == 1 and norm[4] == 0 and norm[5] == 1 and 4 not in kinds and not any(inner.search(p) or "\n" in p for p in normal)
        )
        self.bos, self.eos = self.sp.bos_id(), self.sp.eos_id()
        spelled = []
        for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)):
            if k == 6:
                spelled.append(bytes([int(p[3:-1], 16)]))
            elif k == 3:
                spelled.append(b"")
            elif k == 2:
                spelled.append(self.sp.decode([i]).encode())
            else:
                spelled.append(p.replace(MARK, " ").encode())
        self.piece_len = np.array([len(x) for x in spelled], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.lone = self.sp.encode("\n")[:1] if self.by_pre_token else []
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.count: np.ndarray = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def encode_pre_token(self, parts: list[bytes]) -> list[list[int]]:
        """Ids of pre-tokens; the library puts a space before each text, which stands for the first one of a run."""
        texts = [p[1:].decode() if p[:1] == b" " else p.decode() for p in parts]
        ids = self.sp.encode(texts, num_threads=1)
        return [self.lone if p == b" " else x if p[:1] == b" " else x[1:] for p, x in zip(parts, ids, strict=True)]

    def _slots(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, keep_ids: bool) -> np.ndarray | None:
        """The place in memory of each pre-token; new ones are encoded, each once.

        Pre-tokens are told apart by 128 bits; None where 64 of them are equal and the others aren't.
        """
        second = X.bytes_hash(buf, starts, ends, 1)
        keys, where, inverse = np.unique(X.bytes_hash(buf, starts, ends), return_index=True, return_inverse=True)
        if (second != second[where][inverse]).any():
            return None
        if len(self.keys) > REMEMBERED:
            self._forget()
        pos = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = pos < len(self.keys)
        known[inside] = self.keys[pos[inside]] == keys[inside]
        if (self.check[self.slot[pos[known]]] != second[where[known]]).any():
            return None
        new = np.flatnonzero(~known)
        if len(new):
            raw = buf.tobytes()
            ids = self.encode_pre_token([raw[a:b] for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist(), strict=True)])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            if keep_ids:
                self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(sizes) - sizes))
                self.flat = np.concatenate((self.flat, np.fromiter((y for x in ids for y in x), np.int32, int(sizes.sum()))))
            self.count = np.concatenate((self.count, sizes))
            self.check = np.concatenate((self.check, second[where[new]]))
            self.keys = np.insert(self.keys, pos[new], keys[new])
            self.slot = np.insert(self.slot, pos[new], np.arange(len(self.count) - len(new), len(self.count)))
            pos = np.searchsorted(self.keys, keys)
        return self.slot[pos][inverse]

    def normalised(self, c: X.Chunk) -> tuple[X.Chunk, np.ndarray]:
        """The chunk's texts in normal form, and of each byte of it (and each text's end) the byte of its source text.

        The end of text k is at ``offs[k + 1] + k``: each text has one entry more than it has bytes.
        """
        if not len(self.char_map.units):  # only space marks have a form of their own: every one becomes a space
            mark = np.flatnonzero((c.buf[:-2] == 0xE2) & (c.buf[1:-1] == 0x96) & (c.buf[2:] == 0x81))
            mark = mark[np.searchsorted(c.offs, mark, "right") == np.searchsorted(c.offs, mark + 2, "right")]
            keep = np.ones(len(c.buf), bool)
            keep[np.concatenate((mark + 1, mark + 2))] = False
            buf = c.buf.copy()
            buf[mark] = 32
            offs = np.concatenate(([0], np.cumsum(keep)))[c.offs]
            sizes = np.diff(c.offs)
            own = np.arange(len(c.buf)) - np.repeat(c.offs[:-1], sizes)
            return X.Chunk(c.lo, c.hi, buf[keep], offs, c.null), np.insert(own[keep], offs[1:], sizes)
        forms = [self.char_map.normalise(X.text_of(c, k)) for k in range(len(c))]
        offs = np.concatenate(([0], np.cumsum([len(f) for f, _ in forms]))).astype(np.int64)
        return X.Chunk(c.lo, c.hi, np.frombuffer(b"".join(f for f, _ in forms), np.uint8), offs, c.null), np.concatenate([a for _, a in forms])

    def _pre_tokens(self, c: X.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of a chunk in normal form: bytes with a space before each text, pre-token starts and ends, and each text's first pre-token."""
        some = c.offs[:-1][np.diff(c.offs) > 0]
        buf = np.insert(c.buf, some, 32)
        offs = c.offs + np.concatenate(([0], np.cumsum(np.diff(c.offs) > 0)))
        space = buf == 32
        head = space.copy()
        head[1:] &= ~space[:-1]
        head |= buf == 10
        head[offs[:-1][np.diff(offs) > 0]] = True
        starts = np.flatnonzero(head)
        return buf, starts, np.append(starts[1:], len(buf)), np.searchsorted(starts, offs)

    def count_tokens(self, c: X.Chunk) -> np.ndarray:
        """Tokens of each text of the chunk: pieces of each distinct pre-token, times how often the text has it."""
        if not len(c.buf):
            return np.zeros(len(c), np.int64)
        slots = None
        if self.by_pre_token:
            buf, starts, ends, first = self._pre_tokens(self.normalised(c)[0])
            slots = self._slots(buf, starts, ends, False)  # may replace self.count
        if slots is None:
            return np.array([len(self.sp.encode(X.text_of(c, k).decode())) for k in range(len(c))], np.int64)
        kinds = int(slots.max()) + 1
        pairs, often = np.unique(np.repeat(np.arange(len(c)), np.diff(first)) * kinds + slots, return_counts=True)
        return np.bincount(pairs // kinds, often * self.count[pairs % kinds], len(c)).astype(np.int64)

    def encode(self, c: X.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts of the chunk, one after another, where each text's ids begin, and of each id the first and end byte in its text."""
        normal, align = self.normalised(c)
        slots = None
        if self.by_pre_token and len(c.buf):
            buf, starts, ends, at = self._pre_tokens(normal)
            slots = self._slots(buf, starts, ends, True)
        if slots is None:
            each = [self.sp.encode(X.text_of(c, k).decode()) for k in range(len(c))]
            ids, first = np.array([y for x in each for y in x], np.int32), np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int64)
        else:
            sizes = self.count[slots]
            ids, first = self.flat[X.ragged(self.at[slots], sizes)], np.concatenate(([0], np.cumsum(sizes)))[at]
        # each piece's end in the normal form, which has one space less than the pieces spell
        total = np.concatenate(([0], np.cumsum(self.piece_len[ids])))
        n = np.diff(first)
        text = np.repeat(np.arange(len(c)), n)
        size = np.diff(normal.offs)
        end = np.clip(total[1:] - total[first[text]] - 1, 0, size[text])
        begin = np.concatenate(([0], end[:-1]))[: len(end)]
        begin[first[:-1][n > 0]] = 0
        base = (normal.offs[:-1] + np.arange(len(c)))[text]
        return ids, first, align[base + begin], align[base + end]

    def decode(self, ids: np.ndarray, first: np.ndarray) -> list[bytes]:
        """The texts of ids that ``first`` cuts: the pieces' spellings, without the space that encoding put in front."""
        sizes = self.piece_len[ids]
        raw = self.piece_bytes[X.ragged(self.piece_at[ids], sizes)].tobytes()
        at = np.concatenate(([0], np.cumsum(sizes)))[first]
        parts = [raw[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        return [x[1:] if x[:1] == b" " else x for x in parts]


@lru_cache(maxsize=4)
def _load(digest: str, proto: bytes, use: str) -> Model:
    return Model(proto)


def model(proto: bytes, use: str) -> Model:
    """The worker's own copy of a model for one use; it lives, with its memory, as long as the worker."""
    return _load(hashlib.sha256(proto).hexdigest(), proto, use)


def read_model(path: str) -> bytes:
    """A model file; vocabularies are a few MB at most, and what is larger than 64 MB is refused."""
    with open(path, "rb") as f:
        proto = f.read((64 << 20) + 1)
    if len(proto) > 64 << 20:
        raise ValueError(f"{path} is larger than 64 MB")
    return proto
