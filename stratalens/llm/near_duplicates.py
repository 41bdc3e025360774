"""Near-duplicate classes: an exact n-gram Jaccard self-join by PartEnum signatures.

Sets of word shingles with a Jaccard similarity of at least 3/4 differ in at most a seventh of their sizes'
sum. Size bands cover all pairs of such sizes. In each band the
shingle domain is split by hash into groups, and each group into ``parts`` parts. Of any ``d // (spare + 1) + 1``
groups, one holds at most ``spare`` of ``d`` differences, so two similar sets agree there on some choice of
``parts - spare`` parts. A set's signatures are its contents of all such choices in the first groups, up to as many
good ones as its own size asks for. A group is good if each choice holds a shingle that isn't common, and choices
without one aren't signed: the set that stops first has enough good groups behind it, and the other one has signed
these too, so no similar pair is missed. A set with too few good groups signs the choices with a shingle that isn't
common in all groups, and in the first ones also the others, as if nothing were common; where that isn't enough
either, its empty choices as well. Sets that may not differ at all need no signature.

Common shingles are those of passages in many documents, found by summaries of all documents that are merged. Any set
of them gives the same links; they only keep what shares nothing else out of one bucket.

All equal sets are one node. Within a batch, and then over the cluster, the sets that share a signature are compared
with one of them; that links groups of copies in linear work. What shares a signature and is still
in different components is compared across these: small buckets by a join, large ones in blocks
behind an exact bound on the difference. Large buckets that overlap are compared as one group where that takes fewer
comparisons, so that two sets meet once and not in each bucket they share. Every candidate is verified on the whole shingle sets.

Signatures move in packs: a task sorts some million of them and gives out one row for each bin, a range of signatures.
A bin's packs meet in one task, which keeps no more of them than the bin's distinct signatures.

A set's 64-bit key only routes it. Sets with equal keys are told apart by 128 bits.

Defined cases: a null or empty text has no shingles and is linked with nothing; equal rows link; rows with
a null ``doc_id`` link like others, but can't name a component unless all its ids are null; an empty table
gives no rows. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, mix64, scratch, trim, written
from .components import components
from .shingles import Shingler

#: Rows of a lookup table up to which it is broadcast (at most 40 bytes each); beyond it the tables are shuffled.
BROADCAST_ROWS = 200_000
#: Buckets of up to so many sets are joined in SQL; larger ones are compared in blocks of this many rows.
SMALL_BUCKET, BLOCK = 64, 512
#: Distinct sets that a task remembers, to sign copies once.
SEEN = 100_000
#: Rows in one Arrow batch, and bytes of shingles in one.
ROWS_OUT, BYTES_OUT = 100_000, 1 << 22
#: Signatures that a task packs at once and joins at once, bins of signatures at least, and joined ones in a pack.
PACKED, BINS, JOINED = 1 << 18, 1 << 11, 1 << 12
#: Orders of keys by which a bin's leaders are chosen: what isn't linked with one set may be with another one.
ORDERS = 64
#: Bits of a set's parity sketch for each shingle, at least (a power of two in all); sets that differ in d
#: shingles have sketches that differ in at most d bits, also when the longer one is folded to the other's length.
SKETCH_BITS, LEAST_BITS = 1, 256
#: Bytes of sketches up to which they are broadcast (with fewer than ``BROADCAST_ROWS`` sets); beyond it they are shuffled.
BROADCAST_BYTES = 1 << 24
#: Parts of a group, and how many of them a choice leaves out.
PARTS, SPARE = 3, 1
#: Common shingles that are sent to each task at most, counters of a task's summary, and rows from which a shingle is common.
COMMON, COUNTERS, COMMON_ROWS = 1 << 20, 1 << 19, 64
#: Shingles that a task adds to its summary at once.
AT_ONCE = 1 << 19


class PartEnum:
    """Size bands for a Jaccard similarity of 3/4, and the groups, parts and choices of each.

    A pair belongs to the band of its smaller set; a larger set up to 4/3 of a band's end is in that band too.
    """

    def __init__(self, common: np.ndarray | None = None, largest: int = 1 << 40):
        ends, low = [], 1
        while low <= largest:
            ends.append(low * 16 // 9)
            low = ends[-1] + 1
        self.ends, self.common = np.array(ends, np.int64), common
        self.tags: dict[int, tuple] = {}

    def _tag(self, tag: int) -> tuple:
        """(spare, parts, groups, choices as rows of 0 and 1, a number for each group and choice)."""
        if tag not in self.tags:
            r = int(self.ends[tag])
            most, spare, parts = (r + r * 4 // 3) // 7, SPARE, PARTS
            if most <= 3:  # few elements: one group, of so many parts that they are rarely together in one
                spare, parts = max(1, most), (8, 8, 7, 7)[most]
            groups = most // (spare + 1) + 1
            if most > 3:
                groups += 1 + int(0.3 * groups + 0.5 * groups**0.5)
            choices = np.zeros((comb(parts, spare), parts), np.uint64)
            for row, some in zip(choices, combinations(range(parts), parts - spare)):
                row[list(some)] = 1
            number = mix64(np.arange(groups * len(choices), dtype=np.uint64) + np.uint64(tag << 40)).reshape(groups, -1)
            self.tags[tag] = spare, parts, groups, choices, number
        return self.tags[tag]

    def signatures(self, shingles: np.ndarray) -> np.ndarray:
        """Of a sorted set, for its band and for the one before if its partners can be there."""
        size = len(shingles)
        band, out = int(np.searchsorted(self.ends, size)), []
        high = shingles >> np.uint64(32)
        sums, rares = np.zeros(size + 1, np.uint64), np.arange(size + 1)
        np.cumsum(mix64(shingles + np.uint64(0x632BE59BD9B4E019)), out=sums[1:])
        if self.common is not None and len(self.common) and size:
            at = np.minimum(np.searchsorted(self.common, shingles), len(self.common) - 1)
            np.cumsum(self.common[at] != shingles, out=rares[1:])
        for tag in (band, band - 1) if band and 3 * size <= 4 * int(self.ends[band - 1]) else (band,):
            differ = (size + (size * 4 // 3 if tag == band else int(self.ends[tag]))) // 7
            if not differ:
                continue
            spare, parts, groups, choices, number = self._tag(tag)
            cells = ((high * np.uint64(groups * parts)) >> np.uint64(32)).astype(np.int64)  # in order, as the set is
            edges = np.searchsorted(cells, np.arange(groups * parts + 1))
            full, rare = (np.diff(x[edges]).reshape(groups, parts) > 0 for x in (np.arange(size + 1), rares))
            asked = differ // (spare + 1) + 1
            signed = mix64((sums[edges[1:]] - sums[edges[:-1]]).reshape(groups, parts) @ choices.T + number)
            chosen = rare.astype(np.uint64) @ choices.T > 0
            good = np.cumsum(rare.sum(axis=1) > spare)
            if good[-1] >= asked:
                chosen[int(np.searchsorted(good, asked)) + 1 :] = False
            else:
                good = np.cumsum(full.sum(axis=1) > spare)
                until = int(np.searchsorted(good, asked)) + 1
                chosen[:until] |= full[:until].astype(np.uint64) @ choices.T > 0 if good[-1] >= asked else True
            out.append(signed[chosen])
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def set_keys(shingles: np.ndarray, others: np.ndarray) -> tuple[int, int]:
    """128 bits for equal sets: the key that routes a set, and a second one of the shingles' other hashes."""
    n = np.uint64(len(shingles))
    first = mix64(shingles).sum(dtype=np.uint64) + n
    second = mix64(others).sum(dtype=np.uint64) - n
    return tuple(mix64(np.array([first, second], np.uint64)).view(np.int64).tolist())


def sketch(shingles: np.ndarray) -> np.ndarray:
    """The parity of the set's shingles in each bit."""
    size = max(LEAST_BITS, 1 << (SKETCH_BITS * len(shingles) - 1).bit_length())
    return np.packbits(np.bincount((shingles % np.uint64(size)).astype(np.int64), minlength=size) % 2).view(np.int64)


_MORE = {"leader": pa.int64(), "doc_id": pa.int64(), "th": pa.int64(), "k2": pa.int64(), "n": pa.int32()}
_SIGNED, _SHARED = "a long, key long, kind int, more binary", "a long, key long, more struct<leader:long,doc_id:long,th:long,k2:long,n:int>"
#: Kinds of signed rows: a document, a bin's pack of signatures (with the keys of their sets), a pack of sets that share one with a leader.
DOC, PACK, SHARE = range(3)
#: Within its bin a signature goes by 32 bits: what these confuse are candidates like others.
_SIGNATURE = np.dtype([("low", "<u4"), ("key", "<i8")])
_SHARES = np.dtype([("sig", "<i8"), ("key", "<i8"), ("leader", "<i8")])
_DOCUMENT = np.dtype([("there", "<i8"), ("doc_id", "<i8"), ("th", "<i8"), ("k2", "<i8"), ("n", "<i8")])


def _packed(kind: np.dtype, *columns: np.ndarray) -> np.ndarray:
    """The columns as records."""
    out = np.empty(len(columns[0]), kind)
    for name, column in zip(kind.names, columns):
        out[name] = column
    return out


def _rows(kind: int, a: np.ndarray, key: pa.Array, data: np.ndarray, begins: np.ndarray) -> pa.RecordBatch:
    """Rows (a, key, kind, more) of records, each of those from its begin on."""
    offsets = (np.append(begins, len(data)) * data.dtype.itemsize).astype(np.int32)
    more = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return pa.RecordBatch.from_arrays([pa.array(a), key, pa.array(np.full(len(a), kind, np.int32)), more], names=["a", "key", "kind", "more"])


def _unpacked(rows: pa.Array, kind: np.dtype) -> np.ndarray:
    """The records of some rows' bytes."""
    sizes = np.asarray(pc.binary_length(rows))
    offset = np.frombuffer(rows.buffers()[1], "<i4", len(rows) + 1 + rows.offset)[rows.offset]
    return np.frombuffer(rows.buffers()[2], np.uint8, int(sizes.sum()), int(offset)).view(kind) if sizes.any() else np.zeros(0, kind)


def _leading(sig: np.ndarray, key: np.ndarray, leader: np.ndarray) -> pa.RecordBatch:
    """Rows of ``_SHARED``: sets that share a signature with a leader."""
    column = pa.StructArray.from_arrays([pa.array(leader), *(pa.nulls(len(key), t) for t in list(_MORE.values())[1:])], names=list(_MORE))
    return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(key), column], names=["a", "key", "more"])


def _sorted(sig: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signatures in order, their keys, where a signature begins, and the smallest key of all that are equal."""
    order = np.argsort(sig)
    sig, key = sig[order], key[order]
    begins = np.r_[True, sig[1:] != sig[:-1]]
    return sig, key, begins, np.minimum.reduceat(key, np.flatnonzero(begins))[np.cumsum(begins) - 1]


class Signer:
    """Collects the signatures of sets, and gives them out in packs, with what shares one among them already joined."""

    def __init__(self, common: np.ndarray, bins: int = BINS):
        self.enum, self.bins, self.out, self.size = PartEnum(common), np.uint64(bins), [], 0

    def add(self, key: int, shingles: np.ndarray) -> bool:
        """Whether enough is there to give out."""
        signed = self.enum.signatures(shingles)
        self.out.append((signed, np.full(len(signed), key)))
        self.size += len(signed)
        return self.size >= PACKED

    def batches(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            sig, key = map(np.concatenate, zip(*self.out))
            bins, low = ((sig >> np.uint64(32)) * self.bins) >> np.uint64(32), sig & np.uint64(0xFFFFFFFF)
            sig, key, begins, leader = _sorted((bins << np.uint64(32) | low).view(np.int64), key)
            one, bins = sig[begins], sig[begins] >> 32
            first = np.flatnonzero(np.r_[True, bins[1:] != bins[:-1]])
            yield _rows(PACK, bins[first], pa.nulls(len(first), pa.int64()), _packed(_SIGNATURE, one & 0xFFFFFFFF, leader[begins]), first)
            rest = key != leader
            if rest.any():
                first = np.arange(0, int(rest.sum()), JOINED)
                to = mix64(sig[rest][first].view(np.uint64)).view(np.int64)  # what is joined already goes anywhere
                yield _rows(SHARE, to, pa.nulls(len(first), pa.int64()), _packed(_SHARES, sig[rest], key[rest], leader[rest]), first)
        self.out, self.size = [], 0


class Joiner:
    """Joins packs that come in the order of their bins. What it keeps of a bin whose packs may go on is a leader for each signature."""

    def __init__(self):
        self.sig, self.key = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.orders = mix64(np.arange(ORDERS, dtype=np.uint64)).view(np.int64)

    def join(self, bins: np.ndarray, packs: pa.Array) -> Iterator[pa.RecordBatch]:
        sizes = np.asarray(pc.binary_length(packs)) // _SIGNATURE.itemsize
        ends, at = np.cumsum(sizes), 0
        while at < len(bins):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + max(PACKED, len(self.sig)))))
            rows = _unpacked(packs.slice(at, to - at), _SIGNATURE)
            sig = np.concatenate([self.sig, np.repeat(bins[at:to], sizes[at:to]) << 32 | rows["low"].astype(np.int64)])
            key = np.concatenate([self.key, rows["key"]])
            sig, key, begins, leader = _sorted(sig, key ^ self.orders[(sig >> 32) % ORDERS])
            salts = self.orders[(sig >> 32) % ORDERS]
            key, leader = key ^ salts, leader ^ salts
            last = begins & (sig >> 32 == bins[to - 1])
            self.sig, self.key, at = sig[last], leader[last], to
            shared = np.flatnonzero(leader != key)
            shared = shared[np.lexsort((key[shared], sig[shared]))]
            again = (sig[shared][1:] == sig[shared][:-1]) & (key[shared][1:] == key[shared][:-1])  # equal sets of several tasks
            shared = shared[np.r_[True, ~again]] if len(shared) else shared
            if len(shared):
                yield _leading(sig[shared], key[shared], leader[shared])


def _common(docs: DataFrame) -> np.ndarray:
    """The most frequent shingles of all documents, sorted: at most ``COMMON``, of ``COMMON_ROWS`` rows at least.

    Each task sums its rows up in ``COUNTERS`` counters; as these run out, all lose the count of the least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, seen, parts, size = Shingler(), set(), [], 0
        values, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n = np.unique(np.concatenate(parts), return_counts=True) if parts else (values[:0], counts[:0])
            both, weights = np.concatenate([values, new]), np.concatenate([counts, n])
            order = np.argsort(both)
            both, weights = both[order], weights[order]
            begins = np.flatnonzero(np.r_[True, both[1:] != both[:-1]]) if len(both) else np.zeros(0, np.int64)
            both, weights = both[begins], np.add.reduceat(weights, begins) if len(begins) else weights
            if len(both) > COUNTERS:
                weights = weights - np.partition(weights, -COUNTERS - 1)[-COUNTERS - 1]
                both, weights = both[weights > 0], weights[weights > 0]
            return both, weights

        for batch in batches:
            for th, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if th in seen:  # copies of a text are one set
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(th)
                parts.append(shingler.of(text.as_py()))
                size += len(parts[-1])
                if size >= AT_ONCE:
                    values, counts = merged()
                    parts, size = [], 0
        values, counts = merged()
        values, counts = values[counts > 1], counts[counts > 1]
        for i in range(0, len(values), ROWS_OUT):
            yield pa.RecordBatch.from_arrays([pa.array(values[i : i + ROWS_OUT].view(np.int64)), pa.array(counts[i : i + ROWS_OUT])], names=["shingle", "rows"])
        trim()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    found = docs.select(F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, "shingle long, rows long")
    found = found.groupBy("shingle").agg(F.sum("rows").alias("rows")).filter(F.col("rows") >= COMMON_ROWS).orderBy(F.desc("rows"), "shingle").limit(COMMON)
    return np.sort(found.select("shingle").toArrow().column(0).to_numpy().view(np.uint64))


def _signed(docs: DataFrame, common) -> DataFrame:
    """For each row its document, and for each set its signatures; common: the broadcast common shingles."""

    bins = max(BINS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, signer, seen = Shingler(), Signer(common.value, bins), set()
        for batch in batches:
            k1, k2, sizes = (np.zeros(len(batch), t) for t in (np.int64, np.int64, np.int32))
            for i, text in enumerate(batch.column(2)):
                shingles, others = shingler.both(text.as_py())
                k1[i], k2[i] = key = set_keys(shingles, others)
                sizes[i] = len(shingles)
                if not len(shingles) or key in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(key)
                if signer.add(key[0], shingles):
                    yield from signer.batches()
            ids, th = batch.column(0), np.asarray(batch.column(1))
            there, ids = np.asarray(ids.is_valid()), np.asarray(ids.fill_null(0))
            spread = mix64((th ^ k2).view(np.uint64) + ids.view(np.uint64))
            if len(batch):
                yield _rows(DOC, spread.view(np.int64), pa.array(k1), _packed(_DOCUMENT, there, ids, th, k2, sizes), np.arange(len(batch)))
        yield from signer.batches()
        trim()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text")).mapInArrow(run, _SIGNED)


def _shared(signed: DataFrame) -> DataFrame:
    """A row for each document, and with a leader each set that shares a signature with another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joiner = Joiner()
        for batch in batches:
            kinds = np.asarray(batch.column(2))
            docs, packs, shares = (batch.filter(pa.array(kinds == kind)) for kind in (DOC, PACK, SHARE))
            if len(docs):
                x = _unpacked(docs.column(3), _DOCUMENT)
                more = [pa.nulls(len(x), pa.int64()), pa.array(x["doc_id"], mask=x["there"] == 0), pa.array(x["th"]), pa.array(x["k2"]), pa.array(x["n"].astype(np.int32))]
                yield pa.RecordBatch.from_arrays([docs.column(0), docs.column(1), pa.StructArray.from_arrays(more, names=list(_MORE))], names=["a", "key", "more"])
            if len(shares):
                x = _unpacked(shares.column(3), _SHARES)
                for i in range(0, len(x), ROWS_OUT):
                    yield _leading(*(np.ascontiguousarray(x[c][i : i + ROWS_OUT]) for c in _SHARES.names))
            if len(packs):
                yield from joiner.join(np.asarray(packs.column(0)), packs.column(3))
        trim()

    return signed.repartition("a").sortWithinPartitions("a").mapInArrow(run, _SHARED)


def _small(df: DataFrame) -> DataFrame:
    """A written lookup table, broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _sets(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """(key, id, n, shingles, sketch) of the needed sets (doc_id, th, key, k2, id, several), once each."""
    kinds = {"key": pa.int64(), "id": pa.int64(), "n": pa.int32(), "shingles": pa.list_(pa.int64()), "sketch": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, done = Shingler(), set()
        for batch in batches:
            out, size = [], 0
            for text, key, k2, one in zip(batch.column(0), *(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if one in done:
                    continue
                shingles, others = shingler.both(text.as_py())
                if set_keys(shingles, others) != (key, k2):  # another text of the same hash
                    continue
                if len(done) >= SEEN:
                    done.clear()
                done.add(one)
                out.append((key, one, len(shingles), shingles.view(np.int64), sketch(shingles)))
                size += shingles.nbytes
                if size >= BYTES_OUT:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds.values())], names=list(kinds))
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds.values())], names=list(kinds))
        trim()

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))

    def of(some: DataFrame) -> DataFrame:
        some = _small(written(some.select(F.col("doc_id").alias("_doc"), F.col("th").alias("_th"), "key", "k2", "id"), "needed"))
        rows = texts.join(some, texts["doc_id"].eqNullSafe(F.col("_doc")) & (texts["th"] == F.col("_th"))).select("text", "key", "k2", "id")
        return rows.mapInArrow(run, "key long, id long, n int, shingles array<long>, sketch array<long>")

    # Only sets of several rows can come from more than one row of the same id and text.
    return written(of(needed.filter("not several")).union(of(needed.filter("several")).dropDuplicates(["id"])), "sets", large=True)


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (u, v) whose sets have a Jaccard similarity of at least 3/4. Only the sets in ``pairs`` move."""
    ids = _small(written(pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct(), "ends"))
    sets = sets.join(ids, "id", "left_semi")
    a = sets.select(F.col("id").alias("u"), F.col("n").alias("nu"), F.col("shingles").alias("su"))
    b = sets.select(F.col("id").alias("v"), F.col("n").alias("nv"), F.col("shingles").alias("sv"))
    both = pairs.join(a, "u").join(b, "v").filter("4 * least(nu, nv) >= 3 * greatest(nu, nv)")
    both = both.withColumn("common", F.size(F.array_intersect("su", "sv")))
    return both.filter("100 * common >= 75 * (nu + nv - common)").select("u", "v")


_FOLDED = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({0}) div 2), slice({0}, 1 + size({0}) div 2, size({0}) div 2), (x, y) -> x ^ y), {0})"


def _likely(pairs: DataFrame, sketches: DataFrame, by: str) -> DataFrame:
    """(u, v and the rest of ``pairs``), as ids, of the pairs of keys or ids that sizes and sketches don't rule out: differences are at most a seventh of both sizes."""
    a = sketches.select(F.col(by).alias("u"), F.col("id").alias("iu"), F.col("n").alias("nu"), F.col("sketch").alias("bu"))
    b = sketches.select(F.col(by).alias("v"), F.col("id").alias("iv"), F.col("n").alias("nv"), F.col("sketch").alias("bv"))
    size = sketches.agg(F.count("*"), F.sum(8 * F.size("sketch") + 64)).first()
    if size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_BYTES:
        a, b = F.broadcast(a), F.broadcast(b)
    both = pairs.join(a, "u").join(b, "v").filter("iu <> iv and 4 * least(nu, nv) >= 3 * greatest(nu, nv)")
    differ = F.expr(f"aggregate(zip_with({_FOLDED.format('bu', 'bv')}, {_FOLDED.format('bv', 'bu')}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)")
    rest = [c for c in pairs.columns if c not in ("u", "v")]
    return both.filter(7 * differ <= F.col("nu") + F.col("nv")).select(F.col("iu").alias("u"), F.col("iv").alias("v"), *rest)


def _grouped(large: DataFrame) -> DataFrame:
    """(sig, size, id, root, n): the sets of large buckets (sig, size, id, root, n) by what is compared: all buckets that hang together,
    if the square of their sets is at most the sum of the buckets' squares, else each bucket."""
    buckets = written(large.groupBy("sig", "size").agg(F.min("id").alias("least")), "large")
    ends = large.join(buckets.select("sig", "least"), "sig").select(F.col("id").alias("u"), F.col("least").alias("v")).distinct()
    parts = written(components(ends).withColumnRenamed("root", "part"), "parts")
    sets = parts.groupBy("part").agg(F.count("*").alias("sets"))
    costs = _roots(buckets.withColumnRenamed("least", "node"), "node", parts.withColumnRenamed("part", "root"), "part")
    costs = costs.groupBy("part").agg(F.sum(F.col("size").cast("double") * F.col("size")).alias("cost")).join(sets, "part")
    costs = written(costs.select("part", "sets", (F.col("sets").cast("double") * F.col("sets") <= F.col("cost")).alias("whole")), "costs")
    of = parts.join(_small(costs), "part").withColumnRenamed("node", "id")
    rows = large.join(_small(written(of, "places")), "id")
    whole = rows.filter("whole").select(F.col("part").alias("sig"), F.col("sets").alias("size"), "id", "root", "n").distinct()
    return whole.union(rows.filter("not whole").select("sig", "size", "id", "root", "n"))


def _in_blocks(large: DataFrame, sketches: DataFrame) -> DataFrame:
    """Likely pairs (u, v) of one group (sig, size, id, root, n) and different roots."""
    large = large.join(sketches, "id").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    large = large.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.select("sig", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "id", "root", "n", "sketch")

    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["block"] == key[1]], rows[rows["block"] == key[2]]
        ids, roots, sizes = ([x[c].to_numpy(np.int64) for x in (left, right)] for c in ("id", "root", "n"))
        words = [x["sketch"].map(len).to_numpy(np.int64) for x in (left, right)]
        found = [np.zeros((0, 2), np.int64)]
        for size in sorted({*words[0].tolist(), *words[1].tolist()}):  # pairs of that length, or of it and its double
            at = [np.flatnonzero((w == size) | (w == 2 * size)) for w in words]
            if not len(at[0]) or not len(at[1]):
                continue
            bits = [np.array([np.bitwise_xor.reduce(np.reshape(s, (-1, size)), axis=0) for s in x["sketch"].iloc[i]], np.int64).view(np.uint64) for x, i in zip((left, right), at)]
            mine, theirs = at[0], at[1]
            for row, i in zip(bits[0], mine):
                n = sizes[0][i] + sizes[1][theirs]
                differ = np.bitwise_count(row ^ bits[1]).sum(axis=1, dtype=np.int64)
                near = (7 * differ <= n) & (roots[1][theirs] != roots[0][i]) & (4 * np.minimum(sizes[0][i], sizes[1][theirs]) >= 3 * np.maximum(sizes[0][i], sizes[1][theirs]))
                near &= (words[0][i] == size) | (words[1][theirs] == size)
                if key[1] == key[2]:  # each pair of a block once
                    near &= ids[1][theirs] > ids[0][i]
                found.append(np.column_stack([np.full(int(near.sum()), ids[0][i]), ids[1][theirs][near]]))
        pairs = np.concatenate(found)
        return pd.DataFrame({"u": pairs.min(axis=1), "v": pairs.max(axis=1)})

    return large.groupBy("sig", "low", "high").applyInPandas(compare, "u long, v long")


def _roots(nodes: DataFrame, column: str, comps: DataFrame, name: str) -> DataFrame:
    """``nodes`` with the root of the node in ``column``, itself if it has no edge."""
    renamed = comps.select(F.col("node").alias(column), F.col("root").alias(name))
    return nodes.join(renamed, column, "left").withColumn(name, F.coalesce(name, column))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    return _classes(docs).select("doc_id", "n_shingles", "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: one of the smallest doc_id, or any if no row of the class has one.

    Documents without words are classes of their own.
    """
    with scratch() as kept:
        classes = written(_classes(docs).filter("n_shingles > 0").groupBy("doc_id", "th", "component_id", "root").agg(F.count("*").alias("rows")), "classes")
        chosen = classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("th").alias("chosen"))
        rows = classes.join(_small(written(chosen, "chosen")), "root").withColumn("stays", F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("th") == F.col("chosen")))
        rows = written(rows.filter("not stays or rows > 1").select("doc_id", "th", "stays"), "changed")
        hashed, one, other = (free_name(x, docs.columns) for x in ("th", "id", "hash"))
        gone, again = (written(rows.filter(F.col("stays") == stays).select(F.col("doc_id").alias(one), F.col("th").alias(other)), "gone") for stays in (False, True))
        kept += [gone, again]
        out = docs.withColumn(hashed, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))
    gone, again = _small(gone), _small(again)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(one)) & (F.col(hashed) == F.col(other))
    left = out.join(gone, same, "left_anti")
    once = left.join(again, same, "left_semi").dropDuplicates(["doc_id", hashed])
    return left.join(again, same, "left_anti").union(once).drop(hashed)


def _links(sets: DataFrame, buckets: DataFrame) -> DataFrame:
    """All links (u, v) between the sets (key, id, n, shingles, sketch), up to what components already tell, of the
    sets in common buckets (sig, leader, key)."""
    # First each set with the leader that shares most with it, then what is still apart.
    sketches = sets.select("key", "id", "n", "sketch")
    shares = buckets.groupBy(F.col("leader").alias("u"), F.col("key").alias("v")).agg(F.count("*").alias("common"))
    pairs = written(_likely(shares, sketches, "key"), "likely")
    best = written(pairs.groupBy("v").agg(F.max_by("u", F.struct("common", "u")).alias("u")).select("u", "v"), "best")
    edges = written(_linked(best, sets), "links")
    comps = components(edges)
    apart = _roots(_roots(pairs.select("u", "v"), "u", comps, "ru"), "v", comps, "rv").filter("ru <> rv").select("u", "v")
    apart = written(apart.join(best, ["u", "v"], "left_anti").distinct(), "apart")
    edges = written(edges.union(_linked(apart, sets)), "links")
    comps = components(edges)

    # Buckets of three or more sets whose members are not yet one component.
    named = _small(written(_roots(sets.select("key", "id", "n"), "id", comps, "root"), "nodes"))
    ends = buckets.join(named, "key").join(named.select(F.col("key").alias("leader"), *(F.col(c).alias(f"leader_{c}") for c in ("id", "n", "root"))), "leader")
    roots = [F.min(F.least("root", "leader_root")).alias("low"), F.max(F.greatest("root", "leader_root")).alias("high")]
    mixed = written(ends.groupBy("sig").agg(F.count("*").alias("others"), *roots).filter("others > 1 and low <> high").select("sig"), "mixed")
    members = ends.join(mixed, "sig", "left_semi")
    members = written(members.select("sig", "id", "root", "n").union(members.select("sig", "leader_id", "leader_root", "leader_n")).distinct(), "members")
    sizes = written(members.groupBy("sig").agg(F.count("*").alias("size")), "sizes")
    members = members.join(sizes, "sig")

    small = members.filter(F.col("size") <= SMALL_BUCKET)
    a, b = (small.select("sig", F.col("id").alias(x), F.col("root").alias(f"r{x}"), F.col("n").alias(f"n{x}")) for x in "uv")
    across = a.join(b, "sig").filter("u < v and ru <> rv and 4 * least(nu, nv) >= 3 * greatest(nu, nv)").select("u", "v")
    across = across.union(_in_blocks(_grouped(written(members.filter(F.col("size") > SMALL_BUCKET), "in_large")), sketches.select("id", "sketch")))
    across = written(_likely(across.distinct().join(pairs.select("u", "v"), ["u", "v"], "left_anti"), sketches, "id"), "across")
    return edges.union(_linked(across, sets))


def _buckets(shared: DataFrame) -> DataFrame:
    return shared.filter("more.leader is not null").select(F.col("a").alias("sig"), "more.leader", "key")


def _classes(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, th (hash of its text), n_shingles, component_id, root (that names its class)."""
    with scratch() as kept:
        common = docs.sparkSession.sparkContext.broadcast(_common(docs))
        shared = written(_shared(_signed(docs, common)), "shared", large=True)
        rows = shared.filter("more.n is not null").select("key", "more.k2", "more.doc_id", "more.th", F.col("more.n").cast("long").alias("n_shingles"))
        # One row for each set; sets with the key of another set go by their second one.
        one = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "th"))
        first = written(rows.filter("n_shingles > 0").groupBy("key", "k2").agg(one.alias("one"), (F.count("*") > 1).alias("several")), "first")
        twins = _small(written(first.groupBy("key").agg(F.count("*").alias("sets")).filter("sets > 1"), "twins"))
        first = first.join(twins, "key", "left").select("key", "k2", "one.doc_id", "one.th", "several", F.when(F.col("sets") > 1, F.col("k2")).otherwise(F.col("key")).alias("id"))

        buckets = _buckets(shared)
        nodes = buckets.select(F.col("leader").alias("key")).union(buckets.select("key")).distinct()
        edges = _links(_sets(docs, written(first.join(nodes, "key", "left_semi"), "needed")), buckets)

        named = _roots(first.select("key", "k2", "doc_id", "id"), "id", components(edges), "root")
        smallest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        by_key = written(named.join(smallest, "root").select(F.col("key").alias("_key"), F.col("k2").alias("_k2"), "component_id", "root"), "named")
        kept += [shared, by_key]
    out = rows.filter("n_shingles > 0").join(_small(by_key), (F.col("key") == F.col("_key")) & (F.col("k2") == F.col("_k2")))
    columns = "doc_id", "th", "n_shingles", "component_id", "root"
    return out.select(*columns).union(rows.filter("n_shingles = 0").select("doc_id", "th", "n_shingles", "doc_id", F.lit(None).cast("long")))
