import random

import pytest

from stratalens.llm import suffix_dedup

from .brute import repeats

SCHEMA = "doc_id long, text string"


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: "".join(rng.choices("abcdefghij \né中", k=n))
    shared = [fresh(n) for n in (120, 180, 199, 200, 201, 260, 400, 900)]
    rows = [None, "", "short", "a" * 199, "b" * 200, "c" * 201, "ab" * 350, fresh(300) * 3, "0123456789" * 60]
    for _ in range(30):
        parts = [fresh(rng.randrange(0, 300))]
        for _ in range(rng.randrange(0, 4)):
            passage = rng.choice(shared)
            if rng.random() < 0.4:  # a cut of a passage
                begin = rng.randrange(0, len(passage))
                passage = passage[begin : begin + rng.randrange(1, len(passage))]
            parts += [passage, fresh(rng.randrange(0, 60))]
        rows.append("".join(parts))
    rows += [rows[12], rows[13], rows[13]]  # exact copies
    return list(enumerate(rows, 10))


def table(rows):
    return sorted((tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_same_as_counting_every_string(spark, seed):
    rows = corpus(seed)
    assert table(suffix_dedup.digests(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted(repeats(rows))


def test_periodic_texts(spark):
    """Texts that repeat inside a window, whose anchors tie."""
    rows = [(1, "x" * 700), (2, "ab" * 400 + "c" * 300), (3, ("q" * 31 + "r") * 20), (4, ("q" * 31 + "r") * 15 + "s" * 150), (5, "y" * 250 + "z" * 250)]
    assert table(suffix_dedup.digests(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted(repeats(rows))


def test_edge_cases(spark):
    assert suffix_dedup.digests(spark.createDataFrame([], SCHEMA)).collect() == []
    rng = random.Random(9)
    long = "".join(rng.choices("abcdefgh", k=300_000))
    rows = [(1, "k" * 250), (1, "k" * 250), (None, None), (2, long), (3, long[150_000:150_300])]
    frame = spark.createDataFrame([(*r, "t", "s") for r in rows], "doc_id long, text string, t string, spans string")
    got = {(r["doc_id"], r["n_removed"]) for r in suffix_dedup.digests(frame).collect()}
    assert got == {(1, 250), (None, 0), (2, 300), (3, 300)}


def test_texts_lose_their_repeats(spark):
    rng = random.Random(4)
    a, b = ("".join(rng.choices("abcdefgh", k=260)) for _ in range(2))
    rows = [(1, f"<{a}>", 262), (2, f"({a})", 262), (3, b, 260), (4, None, None)]
    frame = spark.createDataFrame([(*r, 1, "a", "b", "c") for r in rows], "doc_id long, text string, n_chars long, _t long, key_ string, SPANS_ string, twin_ string")
    out = suffix_dedup.remove_repeats(frame)
    assert out.columns == frame.columns
    assert sorted(map(tuple, out.collect())) == [(*r, 1, "a", "b", "c") for r in ((1, "<>", 2), (2, "()", 2), (3, b, 260), (4, None, None))]


def test_ids_that_are_null_or_repeat(spark):
    """Different texts of one id, null ids and large ones; one passage in all of them."""
    rng = random.Random(6)
    fresh = lambda n: "".join(rng.choices("abcdefgh", k=n))
    passage = fresh(230)
    rows = [(i, fresh(20) + passage + fresh(40 + k)) for k, i in enumerate([None, None, 5, 5, 2**53 + 1, 2**53 + 3])]
    got = suffix_dedup.digests(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, repeats(rows)))


def test_texts_of_one_hash(spark, monkeypatch):
    """Different texts with equal 64-bit keys stay apart."""
    rows = corpus(7)
    hashed = suffix_dedup.Keys._hashed

    def one_hash(df, first, second):
        out = hashed(df, first, second)
        return out.withColumn(first, suffix_dedup.F.when(suffix_dedup.F.col(first).isNotNull(), suffix_dedup.F.lit(3).cast("long")))

    monkeypatch.setattr(suffix_dedup.Keys, "_hashed", staticmethod(one_hash))
    assert table(suffix_dedup.digests(spark.createDataFrame(rows, SCHEMA)).collect()) == sorted(repeats(rows))


def test_order_over_partition_edges(spark):
    """A key that takes several partitions keeps one rank, and its places count as neighbours."""
    rng = random.Random(8)
    rows = [(rng.choice([1, 1, 1, 2, 3]), 0, 0, k) for k in range(400)]
    frame = spark.createDataFrame(rows, "a long, b long, c long, t long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = suffix_dedup._ranked(frame, ("t",)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranks = {v: i for i, v in enumerate(sorted({r[0] for r in rows}))}
    assert {r["t"]: r["name"] for r in got} == {t: ranks[a] for a, _, _, t in rows}
