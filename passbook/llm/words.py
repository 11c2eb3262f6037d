"""Hashes of words and shingles of whole texts in numpy, a megabyte at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import xxhash

#: Bytes hashed at once.
CHUNK = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_BLANK = re.compile(rb"[\x20\x09-\x0d]")
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[0x20, *range(0x09, 0x0E)]] = True
#: Everything in ASCII but letters and digits, for words without punctuation.
_IS_MARK = np.array([i < 128 and not chr(i).isalnum() for i in range(256)])
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of an odd base and of its inverse, modulo 2**64; those of a very long text aren't kept."""
    if n > 16 * CHUNK:
        return tuple(np.cumprod(np.r_[np.uint64(1), np.full(n - 1, base, np.uint64)], dtype=np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64)))
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(max(n, 2 * CHUNK), base, np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads each 64-bit value over all its bits."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """p[i]: sum of data[j] * base**j over j < i; a slice's hash is (p[e] - p[s]) / base**s."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=out[1:])
    return out


def _pieces(texts: list[bytes]) -> Iterator[tuple[list[int], bytes]]:
    """Texts joined by blanks up to CHUNK bytes; a longer text is cut at blanks."""
    ids: list[int] = []
    parts: list[bytes] = []
    size = 0
    for i, t in enumerate(texts):
        if len(t) > CHUNK:
            if parts:
                yield ids, b" ".join(parts)
                ids, parts, size = [], [], 0
            at = 0
            while at < len(t):
                end = at + CHUNK
                if end < len(t):
                    m = _BLANK.search(t, end)
                    end = m.start() if m else len(t)
                yield [i], t[at:end]
                at = end
            continue
        ids.append(i)
        parts.append(t)
        size += len(t) + 1
        if size >= CHUNK:
            yield ids, b" ".join(parts)
            ids, parts, size = [], [], 0
    if parts:
        yield ids, b" ".join(parts)


def word_hashes(texts: list[bytes], plain: bool = False, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Of texts in UTF-8: hashes of the words [^\\x20\\x09-\\x0D]+ (plain: cut at ASCII punctuation too) with A-Z lower-cased, and each text's word count.

    With stems the hashes have a row for whole words and one for the first so many bytes of each.
    """
    out, counts = [], np.zeros(len(texts), np.int64)
    for ids, joined in _pieces(texts):
        data = np.frombuffer(joined.lower(), np.uint8)
        blank = np.ones(len(data) + 2, bool)
        blank[1:-1] = (_IS_MARK if plain else _IS_BLANK)[data]
        edges = np.flatnonzero(blank[1:] != blank[:-1])
        s, e = edges[0::2], edges[1::2]
        if not len(s):
            continue
        p = prefix_sums(data)
        _, down = powers(len(data))
        part = [mix((p[x] - p[s]) * down[s] + (x - s).astype(np.uint64)) for x in (e, *(np.minimum(e, s + k) for k in stems))]
        out.append(np.stack(part) if stems else part[0])
        if len(ids) == 1:
            counts[ids[0]] += len(s)
        else:
            ends = np.cumsum([len(texts[i]) + 1 for i in ids])
            counts[ids] += np.bincount(np.searchsorted(ends, s, side="right"), minlength=len(ids))
    return (np.concatenate(out, axis=-1) if out else np.zeros((1 + len(stems), 0) if stems else 0, np.uint64)), counts


def shingles(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """Each text's set of k-word shingles as sorted distinct hashes; fewer words: the whole sequence; no words: empty."""
    w, counts = word_hashes(texts)
    at = 0
    for m in counts.tolist():
        own = w[at : at + m]
        at += m
        if m == 0:
            yield own
            continue
        step = min(m, k)
        h = np.full(m - step + 1, step, np.uint64)
        for j in range(step):
            h = mix(h * np.uint64(0x9DDFEA08EB382D69) + own[j : m - step + 1 + j])
        yield np.unique(h)


def set_digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())
