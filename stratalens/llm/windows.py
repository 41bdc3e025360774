"""Content-defined anchors: which 200-byte strings of a text can occur elsewhere.

Every string of ``LENGTH`` bytes is named by the smallest hash of its ``GRAM``-byte substrings. Equal strings
have equal names, and neighbouring strings mostly share theirs, so a text falls into runs of positions with
one name and one anchor (the last place of that hash), some 1.2 for every 100 bytes. A string can only
repeat in another run of the same name.
"""

from __future__ import annotations

import numpy as np
import xxhash

from .common import mix64

LENGTH = 200
GRAM = 32
#: Bytes of text handled at once.
CHUNK = 1 << 18

_BYTES = np.array([xxhash.xxh3_64_intdigest(bytes([b])) for b in range(256)], np.uint64)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hash of the ``size`` bytes from each position."""
    power, width, h, done = _BYTES[data], 1, None, 0
    while True:
        if size & width:  # the sums of powers of two that make up the size, one after the other
            part = power[done:]
            n = min(len(part), len(h)) if done else len(part)
            h = h[:n] * np.uint64(pow(_BASE, width, 1 << 64)) + part[:n] if done else part.copy()
            done += width
        if 2 * width > size:
            break
        power = power[:-width] * np.uint64(pow(_BASE, width, 1 << 64)) + power[width:]
        width *= 2
    h = h[: max(0, len(data) - size + 1)]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    return h


class Substrings:
    """128-bit hashes of any substrings of a text, from prefix sums of two polynomials in its bytes."""

    _bases = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
    _powers: list[tuple[np.ndarray, np.ndarray]] = []

    def __init__(self, data: np.ndarray):
        n, cls = len(data) + 1, Substrings
        if not cls._powers or len(cls._powers[0][0]) < n:
            size = max(n, CHUNK)
            cls._powers = [tuple(np.cumprod(np.r_[np.ones(1, np.uint64), np.full(size, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64))) for base in self._bases]
        values = _BYTES[data]
        self.sums = []
        for (up, _), part in zip(cls._powers, (values, values ^ np.uint64(0xA5A5A5A5A5A5A5A5))):
            total = np.zeros(n, np.uint64)
            np.cumsum(part * up[: n - 1], out=total[1:])
            self.sums.append(total)

    def of(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for total, (_, down) in zip(self.sums, self._powers):
            out.append(mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64)).view(np.int64))
        return out[0], out[1]


def names(grams: np.ndarray) -> np.ndarray:
    """Name of the LENGTH bytes from each position, of all gram hashes."""
    m, width, span = grams, 1, LENGTH - GRAM + 1
    while 2 * width <= span:
        m = np.minimum(m[:-width], m[width:])
        width *= 2
    return np.minimum(m[: len(m) - (span - width)], m[span - width :])


def runs(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, name, first position, number of positions, whole context's two hashes) of each run of the texts."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none.astype(np.uint64), none, none, none, none
    ends = np.cumsum(sizes)
    grams = gram_hashes(data)
    name = names(grams)
    edge = np.zeros(len(name) + 1, np.int8)  # +1 where valid positions begin, -1 after their end
    long = sizes >= LENGTH
    np.add.at(edge, (ends - sizes)[long], 1)
    np.add.at(edge, ends[long] - LENGTH + 1, -1)
    valid = np.cumsum(edge[:-1]).astype(bool)
    change = np.ones(len(name) + 1, bool)
    change[1:-1] = (name[1:] != name[:-1]) | (valid[1:] != valid[:-1])
    change[1:-1] |= grams[LENGTH - GRAM + 1 :] == name[1:]  # the anchor is the last place of the smallest hash
    at = np.flatnonzero(change)
    first, count = at[:-1], np.diff(at)
    first, count = first[valid[first]], count[valid[first]]
    text = np.searchsorted(ends, first, side="right")
    return text, name[first], first - (ends - sizes)[text], count, *Substrings(data).of(first, first + count + LENGTH - 1)


def chunks(texts: list[bytes]):
    """(number of the first text, texts) of at most about CHUNK bytes, or one long text."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield begin, texts[begin:i]
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, texts[begin:]
