import random

import numpy as np
import pytest
import xxhash

from stratalens.llm import simhash

from .brute import WORD, lower

SCHEMA = "doc_id long, text string"


def plain(text):
    """The fingerprint by counting bits."""
    words = WORD.findall(lower(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def classes(fps):
    """The smallest id reachable over all pairs, of (id, fingerprint) rows."""
    root = {i: i for i, _ in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(fps):
        for j, y in fps[a + 1 :]:
            if (x ^ y).bit_count() <= 2:
                r, s = sorted((find(i), find(j)))
                root[s] = r
    return {i: find(i) for i, _ in fps}


def corpus(seed):
    rng = random.Random(seed)
    rows = [None, "", " \t\n", "one", "One", "one two", "ONE two three", "Été deux\x0btrois quatre", "a b c d"]
    for _ in range(20):
        words = [f"W{rng.randrange(500)}" for _ in range(rng.choice([3, 10, 80, 400]))]
        rows.append(" ".join(words))
        for _ in range(4):  # drifting copies
            words[rng.randrange(len(words))] = f"x{rng.random()}"
            rows.append("\n".join(words))
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)] + [(1, rows[0])]


@pytest.mark.parametrize(("group", "heavy"), [(2048, 1 << 14), (1, 1 << 14), (4, 3)])
def test_same_as_all_pairs(spark, monkeypatch, group, heavy):
    """Few anchors, many anchors, and anchors most of which are heavy."""
    monkeypatch.setattr(simhash, "GROUP", group)
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    rows = corpus(group)
    got = sorted((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    fps = [(i, plain(t)) for i, t in rows]
    component = classes(fps)
    assert got == sorted((i, f"{x:016x}", component[i]) for i, x in fps)
    assert len(set(component.values())) < len(rows) - 5


def balls(rng, n):
    """Fingerprints in chains of one or two bits' steps, beside far ones."""
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 30)):
            out.add(x)
            for _ in range(rng.randrange(1, 4)):
                x ^= 1 << rng.randrange(64)
    return sorted(out)


@pytest.mark.parametrize("blocks", [2, 6, 12, 20, 30])
def test_linked_fingerprints_meet_at_a_home(blocks):
    """Every pair that differs in two bits is at the home of one of both, within radius plus threshold of it."""
    rng, code = random.Random(blocks), simhash.CoveringCode(blocks)
    x = np.array([rng.getrandbits(64) for _ in range(300)], np.uint64)
    y = x ^ np.array([1 << rng.randrange(64) | 1 << rng.randrange(64) for _ in x], np.uint64)
    at, anchor = code.anchors(y)
    sent = {(int(i), int(a)) for i, a in zip(at, anchor)}
    assert len(sent) == len(at) and all((i, int(h)) in sent for i, h in enumerate(code.home(x)))
    words = [sum(m for k, m in enumerate(code.masks) if int(a) >> k & 1) for a in anchor]
    radius = sum(n // 2 for n in code.lengths)
    assert sum(code.lengths) == 64 and all((int(y[i]) ^ w).bit_count() <= radius + 2 for i, w in zip(at, words))
    assert 0.8 < len(at) / len(x) / code.copies() < 1.25


@pytest.mark.parametrize("heavy", [1 << 14, 20])
def test_links_of_fingerprints(spark, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    monkeypatch.setattr(simhash, "GROUP", 16)
    fps = balls(random.Random(heavy), 1500)
    frame = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp long")
    wide = lambda x: x % (1 << 64)
    got = [(wide(r["u"]), wide(r["v"])) for r in simhash.links(frame).collect()]
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in got:
        r, s = sorted((find(u), find(v)))
        root[s] = r
    assert {x: find(x) for x in fps} == classes([(x, x) for x in fps])


def test_edge_cases(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(5, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, "only here and nowhere else"), (7, None), (8, " "), (2**53 + 1, "z y x " * 40_000)]
    frame = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, fp int, root string")
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(frame).collect()), key=str)
    ids = {5: 5, 7: 7, 8: 7, 2**53 + 1: 2**53 + 1}
    want = [(i, f"{plain(t):016x}", ids.get(i, 5 if t == "a b c d" else None)) for i, t in rows]
    assert got == sorted(want, key=str)
