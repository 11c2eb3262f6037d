"""Pre-tokens of texts side by side, split in numpy, and a memory of the ids of each distinct one.

Which code points are blanks, letters or numbers is asked of the library whose ids are wanted, as
libraries follow different versions of Unicode.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np

from passbook.llm.words import mix, powers, prefix_sums

#: Code points that are split at once.
CHUNK = 1 << 17
#: Distinct pre-tokens, and code points of theirs, that a worker remembers before it starts over; bound memory, never results.
REMEMBERED, REMEMBERED_POINTS = 300_000, 1 << 22
# fixed values: code points that some library calls a blank, with others beside them
_BLANKS = "".join(map(chr, [*range(0x21), *range(0x7F, 0xA1), 0x1680, 0x180E, *range(0x2000, 0x2070), 0x3000, 0xFEFF]))
#: Where a long text can be cut, as no pre-token reaches across: before a space that follows no blank, and between a letter and a digit.
_CUT = re.compile(f"(?<=[^{re.escape(_BLANKS)}]) |(?<=[A-Za-z])(?=[0-9])")
# fixed values: the pattern that split() follows, and what an apostrophe at a pre-token's beginning takes with it
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_CONTRACTIONS = ["s", "t", "m", "d", "re", "ve", "ll"]
_BLANK, _LETTER, _NUMBER, _OTHER = range(4)


def kinds(matches: Callable[[str, str], str]) -> np.ndarray:
    """Of each code point: blank, letter, number or other; matches(pattern, text) gives the characters of text that a library's pattern matches."""
    out = np.full(0x110000, _OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, name in ((_BLANK, r"\s"), (_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}")):
        out[np.frombuffer(matches(name, points).encode("utf-32-le"), np.uint32)] = kind
    return out


def split(points: np.ndarray, ends: np.ndarray, kind_of: np.ndarray) -> np.ndarray:
    """Where pre-tokens of texts side by side begin (points: code points; ends: where each text ends).

    A pre-token is a run of letters, of numbers or of other signs, each with one space before it; a
    contraction after an apostrophe that begins one; or blanks, of which the last before something
    else stands apart.
    """
    n = len(points)
    kind = kind_of[points]
    first = np.zeros(n + 1, bool)
    first[0] = True
    first[ends] = True
    blank = kind == _BLANK
    before = np.r_[True, blank[:-1]]
    same = np.r_[False, kind[1:] == kind[:-1]]
    spaced = np.r_[False, points[:-1] == 0x20]
    last = ~first[1:] & np.r_[~blank[1:], True]  # something else follows in the same text
    begin = np.where(blank, last | ~before, ~same & ~spaced) | first[:-1]
    quote = np.flatnonzero((points == 0x27) & begin)
    if len(quote):
        # equal neighbours never begin, so a quote that begins stands first in its run
        text_end = ends[np.searchsorted(ends, quote, side="right")]
        padded = np.r_[points, np.zeros(2, points.dtype)]
        for c in _CONTRACTIONS:
            hit = quote + len(c) + 1 <= text_end
            for k, x in enumerate(c):
                hit &= padded[quote + 1 + k] == ord(x)
            at = quote[hit]
            for k in range(len(c)):
                begin[at + 1 + k] = False
            at = at + 1 + len(c)
            begin[at[at < n]] = True
    return np.flatnonzero(begin)


def _grown(x: np.ndarray, size: int) -> np.ndarray:
    return x if size <= len(x) else np.concatenate([x, np.zeros(max(size - len(x), len(x)), x.dtype)])


class Memory:
    """Ids of texts whose pre-tokens are encoded apart; learn(pieces) gives the ids of pieces, one after another, and how many each has.

    A pre-token is found by a 64-bit hash, and then compared with the remembered one, code point by code point.
    """

    #: Where a long text can be cut.
    cut = _CUT

    def __init__(self, kind_of: np.ndarray, learn: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]):
        self.kind_of, self.learn = kind_of, learn
        self._forget()

    def split(self, points: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return split(points, ends, self.kind_of)

    def _forget(self) -> None:
        self.known: dict[int, int] = {}
        self.offset, self.length, self.place, self.width = (np.zeros(1 << 12, np.int64) for _ in range(4))
        self.ids, self.n_ids = np.zeros(1 << 14, np.uint32), 0
        self.points, self.n_points = np.zeros(1 << 14, np.uint32), 0

    def _find(self, keys: list[int]) -> np.ndarray:
        return np.fromiter(map(self.known.get, keys, repeat(-1)), np.int64, len(keys))

    def _add(self, keys: list[int], pieces: list[str]) -> None:
        flat, lengths = self.learn(pieces)
        widths = np.array([len(p) for p in pieces], np.int64)
        points = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        at, to = len(self.known), len(self.known) + len(pieces)
        self.offset, self.length, self.place, self.width = (_grown(x, to) for x in (self.offset, self.length, self.place, self.width))
        self.ids, self.points = _grown(self.ids, self.n_ids + len(flat)), _grown(self.points, self.n_points + len(points))
        self.offset[at:to], self.length[at:to] = self.n_ids + np.cumsum(lengths) - lengths, lengths
        self.place[at:to], self.width[at:to] = self.n_points + np.cumsum(widths) - widths, widths
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.points[self.n_points : self.n_points + len(points)] = points
        self.n_ids += len(flat)
        self.n_points += len(points)
        self.known.update(zip(keys, range(at, to)))

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that together are about a chunk."""
        ends = np.cumsum([len(t) for t in texts])
        joined = "".join(texts)
        if not joined:
            return [np.zeros(0, np.uint32) for _ in texts]
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        start = self.split(points, np.unique(ends[ends > 0]))
        stop = np.r_[start[1:], len(points)]
        width = stop - start
        sums = prefix_sums(points)
        _, down = powers(len(points))
        h = mix((sums[stop] - sums[start]) * down[start] + width.astype(np.uint64))
        index = self._find(h.tolist())
        new = np.flatnonzero(index < 0)
        if len(new):
            h_new, first = np.unique(h[new], return_index=True)
            if self.known and (len(self.known) + len(h_new) > REMEMBERED or self.n_points + int(width[new[first]].sum()) > REMEMBERED_POINTS):
                self._forget()
                new = np.arange(len(h))
                h_new, first = np.unique(h, return_index=True)
            at = new[first]
            self._add(h_new.tolist(), [joined[s:e] for s, e in zip(start[at].tolist(), stop[at].tolist())])
            index[new] = self._find(h[new].tolist())
        held = self.points.take(np.repeat(self.place[index] - start, width) + np.arange(len(points)), mode="clip")
        if (self.width[index] == width).all() and (held == points).all():
            lengths = self.length[index]
            to = np.cumsum(lengths)
            flat = self.ids[np.repeat(self.offset[index] - (to - lengths), lengths) + np.arange(to[-1])]
        else:  # two pre-tokens share a hash: this chunk goes without the memory
            flat, lengths = self.learn([joined[s:e] for s, e in zip(start.tolist(), stop.tolist())])
            to = np.cumsum(lengths)
        # a text's ids end where its last pre-token's do
        cut = np.r_[0, to][np.searchsorted(start, ends, side="left")]
        return np.split(flat, cut[:-1])

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order; long texts go through in chunks."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        batch: list[tuple[int, str]] = []
        size = 0

        def flush() -> None:
            nonlocal batch, size
            for (i, _), ids in zip(batch, self._chunk([t for _, t in batch])):
                out[i].append(ids)
            batch, size = [], 0

        for i, t in enumerate(texts):
            at = 0
            while True:
                m = self.cut.search(t, at + CHUNK) if len(t) - at > CHUNK else None
                end = m.start() if m else len(t)
                batch.append((i, t[at:end]))
                size += end - at
                if size >= CHUNK:
                    flush()
                at = end
                if at >= len(t):
                    break
        if batch:
            flush()
        for parts in out:
            yield parts[0] if len(parts) == 1 else np.concatenate(parts)
