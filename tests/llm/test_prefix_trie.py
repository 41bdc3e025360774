import hashlib
import random
import zlib

import pytest

from stratalens.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """All nodes as rows, from every prefix of every rebuilt conversation."""
    own = {}
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own.setdefault(c, []).append((role or "", text or ""))
    paths = {c: (*own.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)], *t[h:]) for c, t in own.items()}
    members = {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    children, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            for sums, more in ((children, 1), (leaves, leaves[p]), (saved, saved[p])):
                sums[p[:-1]] += more
    ends = {p: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p)))).encode()).hexdigest() for p, m in members.items()}
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p], ends[p]) for p, m in members.items()), key=str)


def got(spark, rows):
    return sorted((tuple(r) for r in prefix_trie.trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)


def corpus(seed):
    """Conversations that share beginnings of all lengths, a long one, and ones too short to borrow past."""
    rng, rows = random.Random(seed), []
    stems = [[(rng.choice(["user", "assistant", None]), rng.choice([None, "", "é", f"t{k}{rng.random()}"])) for k in range(90)] for _ in range(3)]
    for c in range(80):
        stem = rng.choice(stems)
        n = rng.choice([1, 2, 5, 9, 15, 16, 17, 32, 33, 48, 64, 65, 90])
        path = [*stem[: rng.randrange(n + 1)]]
        path += [("user", f"own {rng.randrange(3)}") for _ in range(n - len(path))]
        turns = [(c, 10 * k + 7, role, text) for k, (role, text) in enumerate(path)]
        if c % 7 == 0:
            turns[0] = (c, None, *turns[0][2:])
        rows += turns
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "base", "ids"), [(1, 16, 4096), (2, 2, 4), (3, 1, 1)])
def test_same_as_all_prefixes(spark, monkeypatch, seed, base, ids):
    """Cuts at up to seven levels, and members in many ranges of ids."""
    monkeypatch.setattr(prefix_trie, "BASE", base)
    monkeypatch.setattr(prefix_trie, "IDS", ids)
    rows = corpus(seed)
    assert got(spark, rows) == plain(rows)


def test_shuffled_lookups(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BROADCAST_ROWS", 0)
    rows = corpus(4)
    assert got(spark, rows) == plain(rows)


def test_edge_cases(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
    rows = [(10, None, None, None), (10, None, None, None), (-4, 1, "user", "x" * 200_000), (2**53 + 1, 1, "a", "b"), (7, 1, "a:", "b"), (7, 2, "a", ":b")]
    want = plain([r for r in rows if r[0] != -4])
    assert [r for r in got(spark, [r for r in rows if r[0] != -4])] == want
    frame = spark.createDataFrame([(*r, b"n", 1) for r in rows], SCHEMA + ", name binary, row int")
    assert sum(r["n_convs"] for r in prefix_trie.trie(frame).filter("depth = 0").collect()) == 4
