"""Byte-level BPE ids of whole texts, as the tokenizers library gives them for its byte_bpe_50k.json.

Ids are those of the library's defaults: the string of an added token in a text is that token's id. Distinct pieces recur a lot, so pieces are found and hashed in numpy, only pieces not seen before by this worker go
through the BPE, and ids are gathered from a bounded table. That holds for texts whose characters are all below U+0250,
where the letter, digit and space classes are settled, and which hold no added token; any other text goes through the
tokenizers library itself.
"""

from __future__ import annotations

import base64
import json
import re
import unicodedata
from functools import cached_property
from itertools import chain

import numpy as np

from inkstone.llm.kernels import U, run_hashes, spread

LATIN = 0x250
#: Pieces that a worker remembers (about 60 bytes each).
MOST_PIECES = 2_000_000
_S, _L, _N, _O, _X = 0, 1, 2, 3, 4


def _classes() -> np.ndarray:
    """Space, letter, digit or other by character; two-byte white space is left to the library (_X)."""
    out = np.full(LATIN, _O, np.uint8)
    for c in range(LATIN):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = _L
        elif kind == "N":
            out[c] = _N
        elif c in (9, 10, 11, 12, 13, 32):
            out[c] = _S
        elif c in (0x85, 0xA0):
            out[c] = _X
    return out


_CLASS = _classes()
_MASK = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=U)


def kinds(data: np.ndarray) -> np.ndarray:
    """The class of each byte's character; _X marks a character that is not handled here."""
    kind = _CLASS[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        code = ((data[lead] & 0x1F).astype(np.int64) << 6) | (data[lead + 1] & 0x3F)
        own = np.where(data[lead] < 0xCA, _CLASS[np.minimum(code, LATIN - 1)], _X)
        own[code >= LATIN] = _X
        kind[lead] = kind[lead + 1] = own
    return kind


def piece_starts(data: np.ndarray, kind: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where pieces begin in UTF-8 texts set end to end (starts and ends of the texts that are not empty).

    The rules are those of the public byte-level pattern: contractions, then an optional blank with a run of letters,
    of digits or of other characters, then white space, whose last character goes with what follows.
    """
    n = len(data)
    head = np.zeros(n + 1, bool)
    head[starts] = True
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(kind[1:], kind[:-1], out=begin[1:])
    begin |= head[:n]
    # white space before something else in the same text: its last character starts a piece
    space = kind == _S
    last_space = np.zeros(n, bool)
    last_space[:-1] = space[:-1] & ~space[1:] & ~head[1:n]
    begin |= last_space
    # a plain blank in that place joins what follows
    begin[np.flatnonzero(last_space & (data == 32)) + 1] = False
    # contractions: an apostrophe that begins a piece
    quote = np.flatnonzero((data == 39) & begin)
    if len(quote):
        padded = np.concatenate((data, np.zeros(2, np.uint8)))
        end = ends[np.searchsorted(ends, quote, side="right")]
        a, b = padded[quote + 1], padded[quote + 2]
        one = (quote + 1 < end) & ((a == 115) | (a == 116) | (a == 109) | (a == 100))
        two = (quote + 2 < end) & (((a == 114) & (b == 101)) | ((a == 118) & (b == 101)) | ((a == 108) & (b == 108)))
        for q, length in ((quote[one], 1), (quote[two & ~one], 2)):
            begin[q + 1] = False
            stop = q + 1 + length
            stop = stop[stop < n]
            # what is left of the run of letters is a piece of its own, unless a boundary is there anyway
            begin[stop[kind[stop] == _L]] = True
    return np.flatnonzero(begin)


def piece_keys(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit keys of pieces: up to 16 bytes are read as two numbers, longer ones are hashed whole."""
    padded = np.concatenate((data, np.zeros(16, np.uint8)))
    eight = np.ndarray((len(data) + 8,), "<u8", padded, 0, (1,))
    keys = spread((eight[starts] & _MASK[np.minimum(lengths, 8)]) + lengths.astype(U) * U(0x9E3779B97F4A7C15))
    more = np.flatnonzero(lengths > 8)
    keys[more] = spread(keys[more] + (eight[starts[more] + 8] & _MASK[np.minimum(lengths[more] - 8, 8)]) * U(0xD6E8FEB86659FD93))
    long = np.flatnonzero(lengths > 16)
    keys[long] ^= run_hashes(data, starts[long], lengths[long])
    return keys


class Encoder:
    """ids(texts) for one tokenizer file; keeps a bounded table of pieces."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        self.bpe = tiktoken.Encoding("byte_bpe_50k", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.json_path = json_path
        with open(json_path, encoding="utf-8") as f:
            self.added = [t["content"].encode() for t in json.load(f).get("added_tokens", [])]
        self._clear()

    @cached_property
    def whole(self):
        """The library's tokenizer, which workers hold from the first text on that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.json_path)

    def _clear(self) -> None:
        self.sorted, self.slots, self.n = np.zeros(0, U), np.zeros(0, np.int32), 0
        self.near = np.zeros(1 << 22, np.int32)  # by the key's upper bits: a slot that may be the key's
        self.key, self.at, self.size = np.zeros(1 << 16, U), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.int32), 0

    def _learn(self, pieces: list[bytes], keys: np.ndarray) -> None:
        """Adds pieces; keys are sorted and none is known."""
        piece_ids = self.bpe._core_bpe.encode_single_piece
        coded = [piece_ids(p) for p in pieces]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        flat = np.fromiter(chain.from_iterable(coded), np.int32, int(sizes.sum()))
        own = slice(self.n, self.n + len(pieces))
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        while own.stop > len(self.at):
            self.key, self.at, self.size = (np.concatenate((x, np.zeros_like(x))) for x in (self.key, self.at, self.size))
        self.ids[self.used : self.used + len(flat)] = flat
        self.key[own], self.size[own], self.at[own] = keys, sizes, self.used + np.cumsum(sizes) - sizes
        self.near[(keys >> U(42)).astype(np.int64)] = np.arange(own.start, own.stop)
        where = np.searchsorted(self.sorted, keys)
        self.sorted = np.insert(self.sorted, where, keys)
        self.slots = np.insert(self.slots, where, np.arange(own.start, own.stop, dtype=np.int32))
        self.used += len(flat)
        self.n = own.stop

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The slot of each key, and whether it is known."""
        if not self.n:
            return np.zeros(len(keys), np.int32), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.sorted, keys), self.n - 1)
        return self.slots[at], self.sorted[at] == keys

    def encode(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of UTF-8 texts set end to end, and how many each text has."""
        begins = np.concatenate(([0], ends[:-1])).astype(np.int64)
        kind = kinds(data)
        odd = np.flatnonzero(kind == _X)
        raw = data.tobytes()
        if any(t in raw for t in self.added):
            odd = np.append(odd, [m.start() for t in self.added for m in re.finditer(re.escape(t), raw)])  # may straddle two texts, which does no harm
        if not len(odd):
            return self._latin(data, kind, begins, ends)
        other = np.zeros(len(ends), bool)
        other[np.searchsorted(ends, odd, side="right")] = True
        out, counts = [], np.zeros(len(ends), np.int64)
        edges = np.flatnonzero(np.diff(np.concatenate(([-1], other.astype(np.int8), [-1]))))
        for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):  # runs of texts of either kind
            if other[i]:
                for k in range(i, j):
                    ids = np.array(self.whole.encode(data[begins[k] : ends[k]].tobytes().decode(), add_special_tokens=False).ids, np.int32)
                    counts[k] = len(ids)
                    out.append(ids)
            else:
                own = slice(begins[i], ends[j - 1])
                ids, counts[i:j] = self._latin(data[own], kind[own], begins[i:j] - begins[i], ends[i:j] - begins[i])
                out.append(ids)
        return np.concatenate(out), counts

    def _latin(self, data: np.ndarray, kind: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        full = ends > begins
        if not full.any():
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        starts = piece_starts(data, kind, begins[full], ends[full])
        lengths = np.diff(np.append(starts, len(data)))
        keys = piece_keys(data, starts, lengths)
        slot = self.near[(keys >> U(42)).astype(np.int64)]
        missed = np.flatnonzero(self.key[slot] != keys) if self.n else np.arange(len(keys))
        if len(missed):
            own, first, inverse = np.unique(keys[missed], return_index=True, return_inverse=True)
            _, known = self._find(own)
            if self.n + len(own) - known.sum() > MOST_PIECES:  # full: this group's pieces are learned anew
                self._clear()
                missed = np.arange(len(keys))
                own, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
                known = np.zeros(len(own), bool)
            at = missed[first[~known]]
            a, b, raw = starts[at].tolist(), (starts[at] + lengths[at]).tolist(), data.tobytes()
            self._learn([raw[i:j] for i, j in zip(a, b, strict=True)], own[~known])
            slot[missed] = self._find(own)[0][inverse]
        sizes = self.size[slot]
        total = np.cumsum(sizes)
        take = np.repeat(self.at[slot] - (total - sizes), sizes)
        take += np.arange(len(take))
        upto = np.concatenate(([0], total))[np.searchsorted(starts, ends)]
        return self.ids[take], np.diff(np.concatenate(([0], upto)))


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(json_path: str | None = None, ranks_path: str | None = None, pattern: str | None = None) -> Encoder:
    """This process's encoder; the vocabulary's place is a parameter, by default that of the public tokenizers."""
    key = (json_path, ranks_path, pattern)
    if key not in _ENCODERS:
        import public_tokenizers as public

        _ENCODERS[key] = Encoder(json_path or public.path("byte_bpe_50k.json"), ranks_path or public.path("byte_bpe_50k.tiktoken"), pattern or public.PATTERN)
    return _ENCODERS[key]
