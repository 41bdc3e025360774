"""SimHash near-duplicate classes: fingerprints of word shingles, compared at the anchors of a covering code.

A text's fingerprint has a bit set where over half of its shingles' hashes have it (XXH64 with seed 42 of three
lower-cased words joined by a space, repeats included; the whole sequence where there are fewer). Two fingerprints link
if at most ``DIFFER`` bits differ.

The 64 bits are cut into blocks of odd length. The code holds all words whose blocks are constant; a block of 2r + 1 bits
is within r of its majority, so the code covers with the sum of these radii, and a fingerprint's home is the anchor of its
majorities. Every fingerprint is sent to all anchors within covering radius plus threshold, counted by block: where the
home of x is, x is within each block's radius, and y, which differs from x in few bits, exceeds these radii by no
more than that in all. So y is sent to x's home, and at each anchor its home fingerprints are compared with all that came.
The number of blocks follows the number of distinct fingerprints, so that an anchor gets some ``GROUP`` of them whatever
the size of the input.

Copies meet in one fingerprint first. An anchor that gets more than ``HEAVY`` (many fingerprints in one small
ball) isn't compared in a task: all its fingerprints are sent to every point within half the threshold of them, the finest
code, of radius 0. Two that link have a point halfway, and what meets in a point links. At most 65 meet there.

Defined cases: a null text is empty; a text without words has fingerprint zero and links like any other; rows without an
id link, but name a component only if all its ids are null; an empty table gives no rows. Further columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch, trim, written
from .components import components

WORDS, SEED, BITS, DIFFER = 3, 42, 64, 2
#: Fingerprints that an anchor gets on average, at most, and from which it counts as heavy.
GROUP, HEAVY = 2048, 1 << 14
#: Rows of a lookup table up to which it is broadcast (16 bytes each); beyond it the tables are shuffled.
BROADCAST_ROWS = 200_000
#: Hashes that are counted at once, and comparisons that are made at once.
HASHES, CELLS = 1 << 14, 1 << 20


def fingerprint(text: bytes) -> int:
    """Of a text in UTF-8."""
    words = text.lower().split()  # bytes: ASCII letters and spaces only
    if not words:
        return 0
    shingles = max(1, len(words) - WORDS + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    begins = np.concatenate([[0], ends[:-1]])[:shingles].tolist()
    joined, ends = b" ".join(words), (ends[-shingles:] - 1).tolist()
    counts = np.zeros(BITS, np.int64)
    for k in range(0, shingles, HASHES):
        hashes = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins[k : k + HASHES], ends[k : k + HASHES])]
        counts += np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > shingles, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(text.as_py()) for text in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])
        trim()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(run, "doc_id long, fp long")


class CoveringCode:
    """Words of 64 bits in an even number of blocks of odd length, each block constant. An anchor's number has a bit for each block."""

    def __init__(self, blocks: int):
        longer, short = divmod(BITS - blocks * ((BITS // blocks - 1) // 2 * 2 + 1), 2)
        assert blocks % 2 == 0 and not short
        self.lengths = [(BITS // blocks - 1) // 2 * 2 + (3 if k < longer else 1) for k in range(blocks)]
        at = np.cumsum([0, *self.lengths]).tolist()
        self.masks = [((1 << n) - 1) << a for n, a in zip(self.lengths, at)]

    @classmethod
    def for_size(cls, rows: int) -> CoveringCode:
        """The coarsest code whose anchors get ``GROUP`` of so many spread fingerprints on average."""
        return next(code for blocks in range(2, BITS + 1, 2) if (code := cls(blocks)).copies() * rows <= GROUP << blocks or blocks == BITS)

    def copies(self) -> float:
        """Anchors to which a random fingerprint is sent, on average."""
        by_spent = [1.0, *[0.0] * DIFFER]
        for n in self.lengths:
            chance = [0.0] + [comb(n, n // 2 + 1 - e) / 2 ** (n - 1) if n // 2 + 1 - e >= 0 else 0.0 for e in range(1, DIFFER + 1)]
            by_spent = [x + sum(by_spent[s - e] * chance[e] for e in range(1, s + 1)) for s, x in enumerate(by_spent)]
        return sum(by_spent)

    def _majorities(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The home of each fingerprint, and for each block by how much its other word exceeds the radius."""
        home, excess = np.zeros(len(fps), np.uint64), np.zeros((len(self.lengths), len(fps)), np.int64)
        for k, (n, mask) in enumerate(zip(self.lengths, self.masks)):
            ones = np.bitwise_count(fps & np.uint64(mask)).astype(np.int64)
            most = 2 * ones > n
            home |= most.astype(np.uint64) << np.uint64(k)
            excess[k] = n // 2 + 1 - np.where(most, n - ones, ones)
        return home, excess

    def home(self, fps: np.ndarray) -> np.ndarray:
        return self._majorities(fps)[0]

    def anchors(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in fps, anchor) of every anchor within the radii plus ``DIFFER``."""
        anchor, excess = self._majorities(fps)
        at, left = np.arange(len(fps)), np.full(len(fps), DIFFER)
        for k in range(len(self.lengths)):
            more = excess[k][at] <= left
            left = np.concatenate([left, left[more] - excess[k][at[more]]])
            anchor = np.concatenate([anchor, anchor[more] ^ np.uint64(1 << k)])
            at = np.concatenate([at, at[more]])
        return at, anchor


def joined(home: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A forest (node, root) of the links between the home fingerprints and the whole group (distinct ones)."""
    order = np.argsort(group)
    group = group[order]
    home = np.searchsorted(group, home)
    root = np.arange(len(group))
    for k in range(0, len(home), step := max(1, CELLS // max(1, len(group)))):
        some = home[k : k + step]
        a, b = np.nonzero(np.bitwise_count(group[some][:, None] ^ group[None, :]) <= DIFFER)
        a = some[a]
        while True:
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                break
            a, b = a[apart], b[apart]
            np.minimum.at(root, np.maximum(x[apart], y[apart]), np.minimum(x[apart], y[apart]))
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
    under = root != np.arange(len(group))
    return group[under], group[root[under]]


def _at_anchors(replicas: DataFrame, code: CoveringCode) -> DataFrame:
    """Links (u, v) of the replicas (anchor, fp), as a forest of each anchor's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(anchor: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            begins = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            home, out = code.home(fp) == anchor, []
            for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(fp)]):
                if b - a > 1 and home[a:b].any():
                    out.append(joined(fp[a:b][home[a:b]], fp[a:b]))
            if out:
                u, v = (np.concatenate(x).view(np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

        anchor = fp = np.zeros(0, np.uint64)
        for batch in batches:
            new = [np.asarray(batch.column(k)).view(np.uint64) for k in (0, 1)]
            anchor, fp = np.concatenate([anchor, new[0]]), np.concatenate([fp, new[1]])
            if len(anchor):
                whole = int(np.searchsorted(anchor.view(np.int64), anchor.view(np.int64)[-1]))  # the last anchor may go on
                if whole:
                    yield from compared(anchor[:whole], fp[:whole])
                    anchor, fp = anchor[whole:], fp[whole:]
        if len(anchor):
            yield from compared(anchor, fp)
        trim()

    return replicas.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(run, "u long, v long")


def _halfway(fps: DataFrame) -> DataFrame:
    """Links (u, v) of fingerprints that meet in a point within half the threshold of both."""
    near = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(BITS)))
    met = fps.select("fp", F.explode(near).alias("point")).groupBy("point").agg(F.array_sort(F.collect_list("fp")).alias("met"))  # 65 at most
    return met.filter("size(met) > 1").select(F.explode(F.slice("met", 2, BITS)).alias("u"), F.element_at("met", 1).alias("v")).distinct()


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def links(fps: DataFrame) -> DataFrame:
    """Links (u, v) between the distinct fingerprints (fp), up to what components already tell."""
    code = CoveringCode.for_size(fps.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            at, anchor = code.anchors(fp)
            yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(fp[at].view(np.int64))], names=["anchor", "fp"])
        trim()

    replicas = fps.select("fp").mapInArrow(run, "anchor long, fp long")
    heavy = written(replicas.groupBy("anchor").agg(F.count("*").alias("rows")).filter(F.col("rows") > HEAVY).select("anchor"), "heavy")
    if not heavy.count():
        return _at_anchors(replicas, code)
    dense = written(replicas.join(_small(heavy), "anchor", "left_semi").select("fp").distinct(), "dense")
    return _at_anchors(replicas.join(_small(heavy), "anchor", "left_anti"), code).union(_halfway(dense))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable by links)."""
    with scratch() as kept:
        rows = written(fingerprints(docs), "fingerprints", large=True)  # a task for each piece of the texts
        firsts = written(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "firsts")
        roots = components(links(firsts)).select(F.col("node").alias("fp"), "root")
        named = firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
        named = written(named, "named")
        least = named.groupBy("root").agg(F.min("first").alias("component_id"))
        named = written(named.join(least, "root").select("fp", "component_id"), "classes")
        kept += [rows, named]
    out = rows.join(_small(named), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
