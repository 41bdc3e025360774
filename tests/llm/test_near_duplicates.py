import random

import pytest

from stratalens.llm import near_duplicates as nd
from stratalens.llm.shingles import Shingler

from .brute import near_duplicates, shingle_set

SCHEMA = "doc_id long, text string"


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(at, f"x{rng.random()}"), lambda: out.insert(at, f"y{rng.random()}"), lambda: out.pop(at)])()
    return out


def corpus(seed):
    """Copies, near copies on both sides of the bound, chains, short texts and odd spaces."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [None, "", " \t\n", "one", "One", "one two three", "one two three four", "ONE two three four five", "Été deux trois quatre cinq"]
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([5, 6, 8, 12, 30, 60, 150, 300]))
        rows.append(" ".join(base))
        for _ in range(rng.randrange(1, 6)):
            rows.append("  ".join(edited(rng, base, rng.randrange(0, max(1, len(base) // 12) + 1))).title())
        step = base
        for _ in range(3):  # a chain that drifts away
            step = edited(rng, step, max(1, len(base) // 40))
            rows.append("\n".join(step))
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_same_as_all_pairs(spark, seed, monkeypatch):
    """Whatever counts as common: nothing, or what is in more than one row."""
    monkeypatch.setattr(nd, "COMMON_ROWS", (64, 2)[seed - 1])
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == near_duplicates(rows)


def test_large_buckets_are_compared_in_blocks(spark, monkeypatch):
    """The same classes when every bucket counts as large."""
    monkeypatch.setattr(nd, "SMALL_BUCKET", 1)
    monkeypatch.setattr(nd, "BLOCK", 2)
    rows = corpus(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == near_duplicates(rows)


def test_shingles_are_those_of_words():
    rng = random.Random(3)
    for _ in range(50):
        text = " ".join(rng.choices(["a", "B", "b", "é", "cc", "\x00"], k=rng.randrange(0, 40)))
        assert len(Shingler().of(text.encode())) == len(shingle_set(text))


def test_signatures_meet_at_the_bound():
    """Sets that differ as much as the similarity allows share a signature, in one band or neighbouring ones."""
    import numpy as np

    rng, plain = np.random.default_rng(0), nd.PartEnum()
    for n in [1, 2, 3, 4, 5, 7, 8, 12, 16, 28, 64, 100, 200, 333, 1000]:
        for _ in range(20):
            common = rng.integers(0, 1 << 63, n, dtype=np.uint64)
            for extra in {(n // 3, 0), (n // 6, n // 6), (0, 0)}:  # 4 * common >= 3 * union
                a, b = (np.sort(np.r_[common, rng.integers(0, 1 << 63, k, dtype=np.uint64)]) for k in extra)
                if len(a) + len(b) < 7 * max(1, len(a) + len(b) - 2 * n):
                    continue  # too far apart
                for enum in (plain, nd.PartEnum(np.sort(common[::2])), nd.PartEnum(np.sort(common))):
                    assert len(a) + len(b) == 2 * n or set(enum.signatures(a).tolist()) & set(enum.signatures(b).tolist())


def test_edge_cases(spark):
    one = spark.createDataFrame([], SCHEMA)
    assert nd.near_duplicates(one).collect() == []
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "only here"), (7, None), (8, ""), (9, "a b c d e f " * 30_000)]
    frame = spark.createDataFrame([(*r, 1, "y") for r in rows], "doc_id long, text string, n int, key string")
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(5, 2, 5), (5, 2, 5), (None, 2, 5), (None, 1, None), (7, 0, 7), (8, 0, 8), (9, 6, 9)], key=str)


def test_one_of_each_class_stays(spark):
    rows = corpus(4)
    rows += rows[:4]  # repeated rows
    frame = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, _key2 string")
    kept = [r["doc_id"] for r in nd.representatives(frame).collect()]
    classes = near_duplicates(list(dict(rows).items()))
    with_words = sorted({c for _, (n, c) in classes.items() if n})
    assert sorted(x for x in kept if classes[x][0]) == with_words
    assert {x for x in kept if not classes[x][0]} == {x for x, (n, _) in classes.items() if not n}
    assert nd.representatives(frame).columns == frame.columns


def test_null_ids_link_and_bridge(spark):
    """A chain of near copies whose middle one has no id, among copies of it; ids too large for a float."""
    words = [f"w{i}" for i in range(200)]
    far = [*words[:180], *(f"x{i}" for i in range(20))]
    middle = [*words[:190], *(f"x{i}" for i in range(10, 20))]
    big = 2**53
    assert [len(shingle_set(" ".join(a)) & shingle_set(" ".join(b))) * 100 >= 75 * len(shingle_set(" ".join(a)) | shingle_set(" ".join(b))) for a, b in ((words, middle), (middle, far))] == [True, True]
    rows = [(big + 3, " ".join(far)), (None, " ".join(middle)), (big + 1, " ".join(words)), (None, " ".join(middle)), (None, "no copy of this")]
    got = sorted(((r["doc_id"], r["component_id"]) for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(big + 3, big + 1), (big + 1, big + 1), (None, big + 1), (None, big + 1), (None, None)], key=str)
    kept = nd.representatives(spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, th int, _th string"))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(big + 1, " ".join(words)), (None, "no copy of this")], key=str)


def test_equal_routing_keys_of_different_sets(spark, monkeypatch):
    """Sets of one 64-bit key are still two sets."""
    rows = [(1, "a b c d e f g"), (2, "a b c d e f h"), (3, "p q r s t u v"), (4, "p q r s t u v")]
    shared = nd._shared

    def one_key(signed):
        return shared(signed.withColumn("key", nd.F.lit(7).cast("long")))

    monkeypatch.setattr(nd, "_shared", one_key)
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 3}


def test_words_that_collide_under_any_base_are_two(spark):
    """Words of 1,024 letters that every polynomial modulo a power of two confuses."""
    one = "".join("ab"[k.bit_count() % 2] for k in range(1024))
    two = one.translate(str.maketrans("ab", "ba"))
    hashes = Shingler().word_hashes(f"{one} {two}".encode())
    assert len({tuple(h) for h in hashes.tolist()}) == 2
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(spark.createDataFrame([(1, f"x y {one} z w"), (2, f"x y {two} z w")], SCHEMA)).collect()}
    assert got == {1: 1, 2: 2}


def test_second_keys_are_of_other_hashes():
    """Equal first hashes of different texts still give two keys."""
    import numpy as np

    shingler = Shingler()
    (a, x), (b, y) = (shingler.both(t.encode()) for t in ("a b c d e f", "a b c d e g"))
    assert np.array_equal(shingler.of(b"a b c d e f"), a) and len(x) == len(a)
    assert nd.set_keys(a, x)[1] != nd.set_keys(a, y)[1] and nd.set_keys(a, x)[0] == nd.set_keys(a, y)[0]


def test_signatures_move_in_packs():
    """A row for each bin and not for each signature, of 12 bytes a signature and little more."""
    import numpy as np

    rng = np.random.default_rng(0)
    signer, signed = nd.Signer(np.zeros(0, np.uint64)), 0
    for key in range(300):
        shingles = np.sort(rng.integers(0, 1 << 64, 600, dtype=np.uint64))
        signed += len(signer.enum.signatures(shingles))
        signer.add(key, shingles)
    out = list(signer.batches())
    assert signed > 50_000 and sum(map(len, out)) < signed / 10 and sum(x.nbytes for x in out) < 14 * signed


def test_packs_join_whatever_their_slices(monkeypatch):
    """Bins that go on over slices and batches: sets hang together by a signature as they do in plain Python, and no row comes twice."""
    import numpy as np

    monkeypatch.setattr(nd, "PACKED", 20)
    rng = np.random.default_rng(1)
    sigs = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
    sets = [(int(key), rng.choice(sigs, 12, replace=False)) for key in rng.integers(-(1 << 62), 1 << 62, 60)]
    sets += sets[:20]  # equal sets of another task
    packs, found = {}, []
    for at in range(0, len(sets), 8):
        signer = nd.Signer(np.zeros(0, np.uint64), 3)
        for key, some in sets[at : at + 8]:
            signer.out.append((some, np.full(12, key)))
            signer.size += 12
        for batch in signer.batches():
            for a, kind, more in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if kind == nd.PACK:
                    packs.setdefault(a, []).append(more)
                else:
                    found += [tuple(x) for x in np.frombuffer(more, nd._SHARES).tolist()]
    assert set(packs) <= {0, 1, 2}
    rows, joined, joiner = [(a, x) for a in sorted(packs) for x in packs[a]], [], nd.Joiner()
    for at in range(0, len(rows), 4):
        bins, some = zip(*rows[at : at + 4])
        for batch in joiner.join(np.array(bins), nd.pa.array(some, nd.pa.binary())):
            joined += zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).field("leader").to_pylist())
    assert joined and found
    links = {}
    for sig, key, leader in found + joined:
        assert key != leader
        links.setdefault(sig, []).append({key, leader})
    whole = {}
    for key, some in sets:
        for x in some.tolist():
            whole.setdefault((((x >> 32) * 3) >> 32) << 32 | x & 0xFFFFFFFF, set()).add(key)
    for sig, keys in whole.items():
        reached, ends = {min(keys)}, links.get(sig, [])
        for _ in ends:
            for pair in ends:
                if pair & reached:
                    reached |= pair
        assert reached == keys
