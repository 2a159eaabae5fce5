"""Vectorised pre-tokenisation and a bounded cache of encoded pre-tokens.

A byte-pair encoder works inside pre-tokens, and a corpus repeats them, so each batch is
split by numpy, its distinct pre-tokens are encoded once and the ids are put together by
one gather.  Character classes come from the tokenizers library itself.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

from tracefold.llm.textcore import U64, column_bytes, mix, pieces, powers, slices

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Texts above this many bytes are cut between words, so arrays stay small.
LONG = 4 << 20
#: Pre-tokens kept per worker (about 150 MB).
KEPT = 1_000_000
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


class Classes:
    """Letter, number, space or other, by the library's own regular expressions."""

    def __init__(self):
        from tokenizers import Regex
        from tokenizers.pre_tokenizers import Split
        self.tests = [(k, Split(Regex(p), "removed")) for k, p in
                      ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s"))]
        self.table = np.zeros(0x110000, dtype=np.uint8)

    def of(self, points: np.ndarray) -> np.ndarray:
        got = self.table[points]
        if not got.all():
            for point in np.unique(points[got == 0]).tolist():
                char = chr(point)
                self.table[point] = next((k for k, test in self.tests
                                          if not test.pre_tokenize_str(char)), OTHER)
            got = self.table[points]
        return got


def contractions(points, kinds, first, row_end):
    """Positions of an apostrophe that opens 's 't 'm 'd (length 2) or 're 've 'll (length 3)."""
    at = np.flatnonzero((points == 0x27) & first)
    at = at[at + 1 < row_end[at]] if len(at) else at
    if not len(at):
        return at, at
    one = points[at + 1]
    two = np.where(at + 2 < row_end[at], points[np.minimum(at + 2, len(points) - 1)], 0)
    short = np.isin(one, [ord(c) for c in "stmd"])
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    keep = short | long
    return at[keep], np.where(short, 2, 3)[keep]


def split(points: np.ndarray, bounds: np.ndarray, classes: Classes, spaced: bool):
    """Start, end of every pre-token.

    ``spaced``: a blank belongs to the word after it, runs of white space are pre-tokens,
    numbers stay together.  Otherwise white space goes and every digit stands alone.
    """
    n = len(points)
    kinds = classes.of(points)
    opens = np.zeros(n + 1, dtype=bool)
    opens[bounds[:-1]] = True
    row_start = opens[:n].copy()
    change = np.ones(n, dtype=bool)
    change[1:] = kinds[1:] != kinds[:-1]
    first = change | row_start
    row_end = np.repeat(bounds[1:], np.diff(bounds))
    start = first.copy()
    if spaced:
        at = np.flatnonzero(first & ~row_start & (kinds != SPACE))
        at = at[kinds[at - 1] == SPACE]
        start[at - 1] = True
        start[at] = points[at - 1] != 0x20
        opened = start
    else:
        start |= kinds == NUMBER
        opened = first
    at, size = contractions(points, kinds, opened & first, row_end)
    if len(at):
        start[at + 1] = False
        after = at + size
        start[after[after < row_end[at]]] = True
    starts = np.flatnonzero(start)
    ends = np.append(starts[1:], n)
    if not spaced:
        keep = kinds[starts] != SPACE
        starts, ends = starts[keep], ends[keep]
    return starts, ends


class Encoder:
    """Ids of whole batches; ``encode_words`` gives the ids of new pre-tokens."""

    def __init__(self, encode_words: Callable[[list[str]], list[list[int]]], spaced: bool,
                 normalize: Callable[[str], str] | None = None, special: dict[str, int] | None = None,
                 kept: int = KEPT):
        self.encode_words, self.spaced, self.normalize, self.kept = encode_words, spaced, normalize, kept
        self.special = {k.encode(): v for k, v in (special or {}).items()}
        self.classes = Classes()
        rng = np.random.default_rng(5)
        self.random = rng.integers(1, 1 << 63, 0x110000, dtype=np.uint64)
        self.clear()

    def clear(self) -> None:
        self.slot: dict[int, int] = {}
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used = np.zeros(1 << 18, np.int32), 0

    def add(self, keys: list[int], found: list[list[int]]) -> None:
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        first, total = len(self.slot), int(sizes.sum())
        while first + len(keys) > len(self.starts):
            self.starts, self.sizes = (np.concatenate([a, np.zeros_like(a)]) for a in (self.starts, self.sizes))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used:self.used + total] = [i for ids in found for i in ids]
        self.sizes[first:first + len(keys)] = sizes
        self.starts[first:first + len(keys)] = self.used + np.cumsum(sizes) - sizes
        self.slot.update(zip(keys, range(first, first + len(keys))))
        self.used += total

    def encode_piece(self, raw: bytes, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a run of texts and the number of each text."""
        if self.normalize and not raw.isascii():
            texts = [self.normalize(raw[a:b].decode("utf-8", "replace")) for a, b in zip(offsets[:-1], offsets[1:])]
            bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            text = "".join(texts)
        else:
            text = raw.decode("utf-8")
            if self.normalize:
                text = text.lower()
            lead = np.concatenate([[0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)])
            bounds = lead[offsets]
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        starts, ends = split(points, bounds, self.classes, self.spaced)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(bounds) - 1, np.int64)
        sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(self.random[points] * powers(_BASE, len(points))[:len(points)], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * powers(_INVERSE, len(sums))[starts]
                     + (ends - starts).astype(np.uint64))
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.slot) > self.kept:
            self.clear()
        keys = distinct.tolist()
        new = [i for i, key in enumerate(keys) if key not in self.slot]
        if new:
            at = where[new]
            self.add([keys[i] for i in new],
                     self.encode_words([text[a:b] for a, b in zip(starts[at].tolist(), ends[at].tolist())]))
        slots = np.fromiter(map(self.slot.__getitem__, keys), np.int64, len(keys))[inverse]
        sizes = self.sizes[slots]
        ids = slices(self.flat, self.starts[slots], sizes)
        before = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(before[np.searchsorted(starts, bounds)])

    def encode_special(self, text: bytes) -> np.ndarray:
        """A text that holds strings of special tokens."""
        out, at = [], 0
        while at < len(text):
            hits = [(p, -len(s), s) for s in self.special if (p := text.find(s, at)) >= 0]
            stop, _, name = min(hits) if hits else (len(text), 0, b"")
            if stop > at:
                out.append(self.encode_text(text[at:stop]))
            if name:
                out.append(np.array([self.special[name]], np.int32))
            at = stop + len(name)
        return np.concatenate(out) if out else np.zeros(0, np.int32)

    def encode_text(self, text: bytes) -> np.ndarray:
        """One text, in slices cut before a blank between ASCII letters when it is long."""
        if len(text) <= LONG:
            return self.encode_piece(text, np.array([0, len(text)]))[0]
        data, out, at = np.frombuffer(text, np.uint8), [], 0
        while at < len(text):
            stop = len(text)
            if stop - at > LONG:
                block = data[at + LONG // 2:at + LONG]
                letter = ((block | 32) >= 97) & ((block | 32) <= 122)
                good = np.flatnonzero((block[1:-1] == 32) & letter[:-2] & letter[2:])
                stop = at + LONG // 2 + 1 + int(good[-1]) if len(good) else stop
            out.append(self.encode_piece(text[at:stop], np.array([0, stop - at]))[0])
            at = stop
        return np.concatenate(out)

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, last row, ids, ids per row) over the rows of a binary column."""
        data, offsets = column_bytes(column)
        for first, last in pieces(offsets, LONG // 2):
            o = offsets[first:last + 1]
            raw = data[o[0]:o[-1]].tobytes()
            odd = any(s in raw for s in self.special)
            if last - first > 1 and odd:
                rows = [self.encode_special(raw[a:b]) for a, b in zip(o[:-1] - o[0], o[1:] - o[0])]
                yield first, last, np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
            elif odd or len(raw) > LONG:
                ids = self.encode_special(raw)
                yield first, last, ids, np.array([len(ids)], np.int64)
            else:
                yield first, last, *self.encode_piece(raw, o - o[0])
