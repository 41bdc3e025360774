"""Plain single-process versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def shingle_set(text: str | None, size: int = 5) -> frozenset:
    words = WORD.findall(lower(text or ""))
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + size]) for i in range(len(words) - size + 1))


def near_duplicates(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id to (n_shingles, component_id), from all pairs."""
    sets = [(i, shingle_set(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                r, s = sorted((find(i), find(j)))
                root[s] = r
    return {i: (len(x), find(i)) for i, x in sets}


def repeats(rows: list[tuple[int, str | None]], length: int = 200) -> list[tuple[int, int, int, int, str]]:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) by counting every string of ``length`` bytes."""
    data = [(i, (t or "").encode()) for i, t in rows]
    seen = Counter(b[k : k + length] for _, b in data for k in range(len(b) - length + 1))
    out = []
    for i, b in data:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def statistics(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def judge_url(url: str | None) -> tuple[str, str, str | None]:
    """host, path, rule."""
    rules = ["net/", "example.net/en/", "example.com/de/", "org/fr/"]
    if url is None or "://" not in url:
        return "", "", None
    after = url.split("://", 1)[1]
    host = lower(re.split(r"[/?#]", after, maxsplit=1)[0])
    path = re.split(r"[?#]", after[len(host) :], maxsplit=1)[0]
    fits = [r for r in rules if ("." + host).endswith("." + r.split("/", 1)[0]) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


def smith_waterman(a: list[str], b: list[str], match: int = 2, mismatch: int = -1, gap: int = -1) -> int:
    last, best = [0] * (len(b) + 1), 0
    for x in a:
        now = [0]
        for j, y in enumerate(b, 1):
            now.append(max(0, last[j - 1] + (match if x == y else mismatch), last[j] + gap, now[-1] + gap))
        best, last = max(best, max(now)), now
    return best


def mcd(x, starts):
    """Rescaled squared distances of the rows from the reweighted estimate of the least determinant, from (number, centre, factor) starts."""
    import numpy as np

    from stratalens.llm import quality_rules as q

    floor = np.diag([s**2 for _, s in q.VECTOR.values()])

    def distances(m, low):
        return (np.linalg.solve(low, (x - m).T) ** 2).sum(axis=0)

    def bins(d2):
        return np.floor(np.log(np.maximum(d2, 1e-9)) * q.BINS).astype(int)

    def upto(b, share):
        return next(v for v in np.unique(b) if (b <= v).sum() >= share * len(b))

    def estimate(rows):
        return rows.mean(axis=0), np.linalg.cholesky(np.cov(rows.T, bias=True) + floor)

    def logdet(low):
        return 2 * np.log(np.diag(low)).sum()

    def step(m, low):
        b = bins(distances(m, low))
        return estimate(x[b <= upto(b, q.KEEP)])

    now = [(k, *step(m, low)) for k, m, low in starts]
    for _ in range(q.FIRST_STEPS - 1):
        now = [(k, *step(m, low)) for k, m, low in now]
    now = sorted(now, key=lambda s: (round(logdet(s[2]), 9), s[0]))[: q.GO_ON]
    for _ in range(q.LAST_STEPS):
        before, now = now, [(k, *step(m, low)) for k, m, low in now]
        if max(abs(logdet(a[2]) - logdet(b[2])) for a, b in zip(before, now)) < 1e-9:
            break
    _, m, low = min(now, key=lambda s: (round(logdet(s[2]), 9), s[0]))

    def rescaled(m, low):
        d2 = distances(m, low)
        return d2 * q.MEDIAN / np.exp((upto(bins(d2), 0.5) + 1) / q.BINS)

    m, low = estimate(x[rescaled(m, low) <= q.WITHIN])
    return rescaled(m, low)
