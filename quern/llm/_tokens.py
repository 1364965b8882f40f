"""Ids of byte spans such as words, each distinct span of a worker encoded once, for models of the tokenizers library."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa

from . import _text as X

#: Distinct spans and ids that a worker remembers before it starts anew; only speed depends on it.
REMEMBERED, REMEMBERED_IDS = 1_500_000, 1 << 24


class Memo:
    """The ids of spans, each distinct one encoded once: those of slot k are ``flat[at[k] : at[k] + count[k]]``.

    ``encode`` takes bytes, starts and ends of spans, and gives their ids one after another and the number of each span's.
    ``generation`` grows when all slots are forgotten.
    """

    def __init__(self, encode: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> None:
        self.encode = encode
        self.generation = self._seed = 0
        self._forget()

    def _forget(self) -> None:
        self.generation += 1
        self.keys = np.zeros(0, np.uint64)
        self.check = np.zeros(0, np.uint64)
        self.slot = np.zeros(0, np.int64)
        self.count: np.ndarray = np.zeros(0, np.int64)
        self.at = np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.int32)

    def slots(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The slot of each span; spans are told apart by two hashes of 64 bits, and where only one is equal, by two others."""
        if len(self.keys) > REMEMBERED or len(self.flat) > REMEMBERED_IDS:
            self._forget()
        second = X.bytes_hash(buf, starts, ends, self._seed + 1)
        keys, where, inverse = np.unique(X.bytes_hash(buf, starts, ends, self._seed), return_index=True, return_inverse=True)
        pos = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = pos < len(self.keys)
        known[inside] = self.keys[pos[inside]] == keys[inside]
        if (second != second[where][inverse]).any() or (self.check[self.slot[pos[known]]] != second[where[known]]).any():
            self._seed += 2
            self._forget()
            return self.slots(buf, starts, ends)
        new = np.flatnonzero(~known)
        if len(new):
            flat, sizes = self.encode(buf, starts[where[new]], ends[where[new]])
            self.keys = np.insert(self.keys, pos[new], keys[new])
            self.slot = np.insert(self.slot, pos[new], np.arange(len(self.count), len(self.count) + len(new)))
            self.at = np.concatenate((self.at, len(self.flat) + np.cumsum(sizes) - sizes))
            self.flat = np.concatenate((self.flat, flat.astype(np.int32)))
            self.count = np.concatenate((self.count, sizes))
            self.check = np.concatenate((self.check, second[where[new]]))
            pos = np.searchsorted(self.keys, keys)
        return self.slot[pos][inverse]

    def ids(self, slots: np.ndarray) -> np.ndarray:
        """The ids of spans one after another."""
        return self.flat[X.ragged(self.at[slots], self.count[slots])]


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((y for x in lists for y in x), np.int64, int(sizes.sum())), sizes


def loaded(spec: bytes):
    """A tokenizer of the tokenizers library from its JSON, without truncation and padding, in one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(spec.decode())
    t.no_truncation()
    t.no_padding()
    return t


#: Bytes next to which a letter always ends or begins a pre-token: ASCII but for letters, white space and the apostrophe, which contractions begin with.
_HARD = np.zeros(256, bool)
_HARD[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_HARD[_LETTER] = False
_HARD[39] = False
#: Texts for which ``WordModel`` compares the ways to encode: marks, contractions, capitals, numbers, accents in both forms, other scripts.
_PROBES = ["don't", "x1\u0301", "\u00c9te\u0301", "a-b_", "\u4f60\u597d", "THE", "10,5%", "na\u00efve,", "\u00e0.", "(so)", "we'LL", "H\u0331", "a\u00d7b", "\u0130x"]


class WordModel:
    """A tokenizer that drops white space and cuts at it, so that a text's ids are those of its words in turn.

    Where pre-tokens are runs of letters and case doesn't count, words are cut further, so that fewer are distinct.
    Both are tried on ``_PROBES``; a model that gives other ids for the parts than for the whole is applied to whole texts.
    """

    def __init__(self, spec: bytes) -> None:
        self._t = loaded(spec)
        self.vocabulary = self._t.get_vocab_size(with_added_tokens=True)
        # texts that hold none of these can't hold an added token
        self._added = sorted({t.content[:2].encode() for t in self._t.get_added_tokens_decoder().values()})
        self._ends = np.zeros(self.vocabulary, bool)
        for token, k in self._t.get_vocab(with_added_tokens=False).items():
            self._ends[k] = token.endswith("</w>")
        self.by_word = self.by_part = True
        probes = pa.array([x + space + y for x in _PROBES for y in _PROBES for space in (" ", "\n\n", "\t ", "")])
        for way in ("by_part", "by_word"):
            self._memo = Memo(self._encode)
            (c,) = X.chunks(probes)
            ids, first = self.encode(c)
            if all(ids[a:b].tolist() == self._t.encode(x, add_special_tokens=False).ids for x, a, b in zip(probes.to_pylist(), first[:-1], first[1:], strict=True)):
                break
            setattr(self, way, False)
        self._memo = Memo(self._encode)

    def _encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = buf.tobytes()
        texts = [raw[a:b].decode(errors="replace") for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        alone = [] if not self.by_part else [k for k, x in enumerate(texts) if x.isalpha()]
        # words of letters alone have one last id each, and can be encoded as one text
        ids = np.array(self._t.encode_batch_fast([" ".join([texts[k] for k in alone])], add_special_tokens=False)[0].ids, np.int64)
        last = np.flatnonzero(self._ends[ids]) + 1
        if len(last) != len(alone):
            alone, ids, last = [], ids[:0], last[:0]
        gone = set(alone)
        others = [k for k in range(len(texts)) if k not in gone]
        flat, sizes = flattened([e.ids for e in self._t.encode_batch_fast([texts[k] for k in others], add_special_tokens=False)])
        order = np.array(alone + others, np.int64)
        n = np.concatenate((np.diff(last, prepend=0), sizes))
        at = np.cumsum(n) - n
        back = np.argsort(order)
        return np.concatenate((ids, flat))[X.ragged(at[back], n[back])], n[back]

    def _parts(self, c: X.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bytes to encode, starts and ends of their parts, and each text's first part."""
        if not self.by_word:
            return c.buf, c.offs[:-1], c.offs[1:], np.arange(len(c) + 1)
        starts, ends, first = X.word_bounds(c.buf, c.offs)
        raw = c.buf.tobytes()
        if not self.by_part or not len(starts) or any(x in raw for x in self._added):
            return c.buf, starts, ends, first
        letter = _LETTER[c.buf]
        latin = np.zeros(len(c.buf), bool)  # last bytes of the letters from U+00C0 to U+023F, without U+0130, whose small form ends in a mark
        lead, last = c.buf[:-1], c.buf[1:]
        latin[1:] = (lead == 0xC3) & (last != 0x97) & (last != 0xB7) | (lead == 0xC4) & (last != 0xB0) | (lead > 0xC4) & (lead <= 0xC8)
        hard = _HARD[c.buf]
        cut = np.flatnonzero((letter | latin)[:-1] & hard[1:] | hard[:-1] & letter[1:]) + 1
        cut = cut[np.searchsorted(starts, cut, "right") == np.searchsorted(ends, cut, "left") + 1]  # not between texts
        cut = cut[~np.isin(cut, starts)]
        starts, ends = np.sort(np.concatenate((starts, cut))), np.sort(np.concatenate((ends, cut)))
        high = np.concatenate(([0], np.cumsum(c.buf >= 128)))
        pure = np.repeat(high[ends] == high[starts], ends - starts)
        buf = c.buf.copy()
        inside = X.ragged(starts, ends - starts)[pure]
        buf[inside] = X.LOWER[buf[inside]]
        return buf, starts, ends, np.searchsorted(starts, c.offs)

    def encode(self, c: X.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of the chunk, one after another, and where each text's begin (and the end)."""
        buf, starts, ends, first = self._parts(c)
        slots = self._memo.slots(buf, starts, ends)
        return self._memo.ids(slots), np.concatenate(([0], np.cumsum(self._memo.count[slots])))[first]


@lru_cache(maxsize=4)
def _load(digest: str, spec: bytes) -> WordModel:
    return WordModel(spec)


def word_model(spec: bytes) -> WordModel:
    """The worker's own copy of a model; it lives, with its memory, as long as the worker."""
    return _load(hashlib.sha256(spec).hexdigest(), spec)
