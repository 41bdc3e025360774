"""Exact repeated-substring removal with a distributed difference-cover suffix sort.

Removes each byte that a ``LENGTH``-byte string covers which also starts somewhere else, in the same document
or another. A full suffix array of a corpus needs many times its size in shuffles, so suffixes are sorted
only where repeats can differ:

1. *Anchors* (``windows``): positions fall into runs by the smallest hash inside their string. A name seen
   once can't repeat. Runs with equal whole contexts repeat at each position and stand for one another.
2. *Blocks*: contexts that share a name but differ are cut, relative to the anchor, into blocks of
   ``BLOCK`` positions. A block whose core (the bytes in all its strings) is unique has no repeat; equal
   hulls (the bytes in any of its strings) repeat wholly. What is left holds an end of a match.
3. *Difference cover* over the distinct hulls left. Positions 1 and 2 modulo 3 are sampled. Their triples of
   ``CHAR``-byte characters are sorted across the cluster and named by rank; the names of three places
   ``STEP`` bytes apart are triples again, sorted and named in the recursion, which ends as names then cover
   ``DEPTH`` bytes. The remaining positions are merged into the order through the ranks of their sampled
   neighbours: any two positions are compared at a shift of 0, 1 or 2 at which both are sampled. Neighbours in
   that order with equal ``LENGTH``-byte prefixes repeat, also over the edges of its partitions.

The orders are dealt out by ranges of key and place, so a key that is common to many places takes several partitions.
Texts, contexts and hulls are told apart by 128 bits. Only hashes are shuffled; texts move once for each of the lookups
in them, and only those that hold candidates.

Defined cases: a null text is empty; texts of under ``LENGTH`` bytes lose nothing; rows with the same text
are copies of each other, whatever their ids; an empty table gives no rows; other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import windows
from .common import discard, free_name, in_arrow, quoted, scratch, trim, written
from .windows import GRAM, LENGTH

BLOCK = 16
#: Bytes named by a sampled position; its string is that and the two bytes on either side of the merge.
DEPTH = LENGTH - 2
#: Bytes of a character, and the distance between the names of a triple in the recursion: 9 characters cover DEPTH.
CHAR, STEP = 22, 66
#: Rows of a lookup table up to which it is broadcast; beyond it both sides are shuffled.
BROADCAST_ROWS, BROADCAST_SPANS = 200_000, 1_000_000
#: Distinct texts that a task remembers, to cut copies once.
SEEN = 200_000
ROWS_OUT = 200_000

def _bytes(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")


class Keys:
    """64-bit keys of the texts of ``LENGTH`` bytes at least. Texts with the hash of another one go by a second hash, so that 128
    bits tell texts apart; ``copies`` has the keys of texts with equal rows."""

    def __init__(self, docs: DataFrame):
        rows = self._hashed(docs.select(_bytes().alias("text")), "t", "t2").filter("t is not null")
        counted = written(rows.groupBy("t", "t2").agg(F.count("*").alias("rows")), "texts")
        self.twins = written(counted.groupBy("t").agg(F.count("*").alias("texts")).filter("texts > 1").select(F.col("t").alias("twin_")), "twins")
        self.few = self.twins.count() <= BROADCAST_ROWS
        self.copies = written(self._told_apart(counted.filter("rows > 1"), "t", "t2").select("t"), "copies")
        discard(counted)
        self.texts = self._told_apart(rows, "t", "t2").select("t", "text")

    @staticmethod
    def _hashed(df: DataFrame, first: str, second: str) -> DataFrame:
        text = _bytes()
        return df.withColumns({first: F.when(F.octet_length(text) >= LENGTH, F.xxhash64(text)), second: F.xxhash64(F.lit("second"), text)})

    def _told_apart(self, df: DataFrame, first: str, second: str) -> DataFrame:
        twins = self.twins.withColumnRenamed("twin_", twin := free_name("twin_", df.columns))
        out = df.join(F.broadcast(twins) if self.few else twins, F.col(first) == F.col(twin), "left")
        return out.withColumn(first, F.when(F.col(twin).isNotNull(), F.col(second)).otherwise(F.col(first))).drop(twin, second)

    def of(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` with the key of its text as ``name``; null for shorter texts."""
        second = free_name("second_", [*df.columns, name])
        return self._told_apart(self._hashed(df, name, second), name, second)


def _emit(columns: dict[str, list], kinds: dict[str, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(columns[c]) if columns[c] else [], kinds[c]) for c in kinds], names=list(kinds))


def _runs(keyed: DataFrame) -> DataFrame:
    """(m, c1, c2, n, t, lo): each run's name, whole context, number of positions, text and first position."""
    kinds = {"m": pa.int64(), "c1": pa.int64(), "c2": pa.int64(), "n": pa.int32(), "t": pa.int64(), "lo": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            out, size = {c: [] for c in kinds}, 0
            keys, texts = [], []
            for t, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if t not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(t)
                    keys.append(t)
                    texts.append(text.as_py())
            for begin, part in windows.chunks(texts):
                text, name, lo, n, c1, c2 = windows.runs(part)
                for c, v in zip(kinds, (name.view(np.int64), c1, c2, n.astype(np.int32), np.array(keys, np.int64)[text + begin], lo.astype(np.int32))):
                    out[c].append(v)
                size += len(text)
                if size >= ROWS_OUT:
                    yield _emit(out, kinds)
                    out, size = {c: [] for c in kinds}, 0
            if size:
                yield _emit(out, kinds)

    return keyed.select("t", "text").mapInArrow(run, "m long, c1 long, c2 long, n int, t long, lo int")


def _several(t: str, at: str) -> list:
    """Aggregates that tell whether a group has more than one place (t, at), and name one."""
    return [F.min(t).alias("t0"), F.max(t).alias("t1"), F.min(at).alias("a0"), F.max(at).alias("a1"), F.min_by(at, t).alias("at0")]


_MANY = "(t0 <> t1 or a0 <> a1)"


def _in_texts(keyed: DataFrame, needed: DataFrame, fields: list[str], run: Callable, schema: str) -> DataFrame:
    """``run`` over (text, list of the needed rows of that text), once for each distinct text."""
    grouped = needed.groupBy("t").agg(F.collect_list(F.struct(*fields)).alias("places"))
    ids = needed.select("t").distinct()
    texts = keyed.select("t", "text")
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids
    texts = texts.join(ids, "t", "left_semi").groupBy("t").agg(F.first("text").alias("text"))
    return texts.join(grouped, "t").select("t", "text", "places").mapInArrow(run, schema)


def _places(column, fields: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """The fields of one text's list of places, as arrays."""
    values = column.values
    return tuple(np.asarray(values.field(values.type.get_field_index(f))) for f in fields)


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, 0, 1, .. within the owner) of so many items each."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def _blocks(keyed: DataFrame, contexts: DataFrame) -> DataFrame:
    """(core, h1, h2, n, t, lo, copied) of each block of the contexts (t, lo, n, m, copied)."""
    kinds = {"core": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "n": pa.int32(), "t": pa.int64(), "lo": pa.int32(), "copied": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in kinds}
            for t, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = np.frombuffer(text.as_py(), np.uint8)
                lo, n, m, copied = _places(places, ("lo", "n", "m", "copied"))
                lo, n = lo.astype(np.int64), n.astype(np.int64)
                grams = windows.gram_hashes(data).view(np.int64)
                within = grams[lo[:, None] + np.arange(LENGTH - GRAM + 1)] == m[:, None]
                anchor = lo + LENGTH - GRAM - within[:, ::-1].argmax(axis=1)  # the last place of the name in the run's first string
                first, last = (anchor - lo) // BLOCK, (anchor - lo - n + 1) // BLOCK
                owner, nth = _spread(first - last + 1)
                block = first[owner] - nth
                core = anchor[owner] - BLOCK * block
                begin, end = np.maximum(lo[owner], core - BLOCK + 1), np.minimum((lo + n - 1)[owner], core)
                substrings = windows.Substrings(data)
                hashes = substrings.of(begin, end + LENGTH)
                values = (substrings.of(core, core - BLOCK + 1 + LENGTH)[0], *hashes, (end - begin + 1).astype(np.int32), np.full(len(begin), t, np.int64), begin.astype(np.int32), copied[owner])
                for c, v in zip(kinds, values):
                    out[c].append(v)
            if len(batch):
                yield _emit(out, kinds)

    return _in_texts(keyed, contexts, ["lo", "n", "m", "copied"], run, "core long, h1 long, h2 long, n int, t long, lo int, copied boolean")


def _triples(keyed: DataFrame, hulls: DataFrame) -> DataFrame:
    """Of each hull (t, lo, n, asked) its sampled places (t, at), as the three triples (a, b, c) of characters at ``step``
    0 to 2. ``at`` packs the hull's ``lo`` and the number of the place in it (16 bits); ``beside`` the two bytes on either side of what
    the triples name, the hull's ``n`` (15 bits) and ``asked`` (the sign)."""
    kinds = dict.fromkeys(("t", "at", "step", "beside", "a", "b", "c"), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [] for c in kinds}
            for t, text, places in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = np.frombuffer(text.as_py(), np.uint8)
                lo, n, asked = (x.astype(np.int64) for x in _places(places, ("lo", "n", "asked")))
                chars = windows.gram_hashes(data, CHAR).view(np.int64)
                owner, i = _spread(n + 2)
                at = lo[owner] + i
                owner, i, at = owner[at % 3 > 0], i[at % 3 > 0], at[at % 3 > 0]
                wide = np.r_[np.zeros(2, np.int64), data, np.zeros(2, np.int64)]  # what lies outside is never compared
                beside = (asked[owner] << 31 | n[owner] << 16) << 32
                for k, shift in zip((-2, -1, DEPTH, DEPTH + 1), (24, 16, 8, 0)):
                    beside |= wide[at + k + 2] << shift
                for step in range(3):
                    q = at + STEP * step
                    for c, v in zip(kinds, (np.full(len(q), t), lo[owner] << 16 | i, np.full(len(q), step), beside if step == 0 else np.zeros_like(beside), chars[q], chars[q + CHAR], chars[q + 2 * CHAR])):
                        out[c].append(v)
            if len(batch):
                yield _emit(out, kinds)
        trim()

    return _in_texts(keyed, hulls, ["lo", "n", "asked"], run, "t long, at long, step long, beside long, a long, b long, c long")


def _sorted(rows: DataFrame, by: tuple[str, ...], place: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """``rows`` (all longs) sorted by ``by`` and ``place`` across the cluster, with the number of their partition and the rank of
    their ``by`` in it, as a written table; and a row for each partition: what its ranks begin at in the whole order, whether its
    first key goes on from the partition before, and its last one in the next. Only the partitions' edges come to the driver."""
    columns = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rank, part = None, -1, TaskContext.get().partitionId()
        for batch in batches:
            if not len(batch):
                continue
            key = np.column_stack([np.asarray(batch.column(c)) for c in by])
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]).any(axis=1)
            new[0] = last is None or (key[0] != last).any()
            local = rank + np.cumsum(new)
            last, rank = key[-1], int(local[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(key), part, np.int64)), pa.array(local)], names=[*columns, "part", "local"])

    schema = ", ".join([*(f"{c} long" for c in columns), "part long", "local long"])
    ordered = written(rows.repartitionByRange(*by, *place).sortWithinPartitions(*by, *place).mapInArrow(run, schema), "order", large=True)
    top = ordered.groupBy("part").agg(F.max("local").alias("top"))
    key = F.struct(*by)
    edge = ordered.join(F.broadcast(top), "part").filter("local = 0 or local = top")  # a partition's first and last key
    edge = edge.groupBy("part", "top").agg(F.min(key).alias("first"), F.max(key).alias("last"))
    total, offsets, before = 0, [], None
    edges = sorted((r["part"], r["top"], tuple(r["first"]), tuple(r["last"])) for r in edge.collect())
    for k, (part, most, first, last) in enumerate(edges):
        goes_on = first == before
        total -= goes_on
        offsets.append((part, total, goes_on, k + 1 < len(edges) and edges[k + 1][2] == last, most))
        total, before = total + most + 1, last
    return ordered, rows.sparkSession.createDataFrame(offsets or [(0, 0, False, False, 0)], "part long, begins long, goes_on boolean, stays boolean, top long")


def _ranked(rows: DataFrame, place: tuple[str, ...]) -> DataFrame:
    """``rows`` with the dense rank of their triple (a, b, c) in the whole order as ``name``."""
    ordered, at = _sorted(rows, ("a", "b", "c"), place)
    columns = [c for c in rows.columns if c not in ("a", "b", "c")]
    return ordered.join(F.broadcast(at), "part").select(*columns, (F.col("begins") + F.col("local")).alias("name"))


def _suffix_repeats(keyed: DataFrame, hulls: DataFrame) -> DataFrame:
    """(t, lo) of the places of the hulls (t, lo, n, asked) that are asked for and whose string starts at another of their places too."""
    names = _ranked(_triples(keyed, hulls), ("t", "at", "step"))
    # The recursion: a sampled place's three names are a triple of the reduced string.
    reduced = names.groupBy("t", "at").agg(F.max(F.when(F.col("step") == 0, F.col("beside"))).alias("beside"), *(F.max(F.when(F.col("step") == k, F.col("name"))).alias(c) for k, c in enumerate("abc")))
    deep = _ranked(reduced, ("t", "at"))
    # Merging: each place by the rank at its shift to a sampled one, with the bytes that complete its string before and after.
    part = lambda k, bits: F.shiftright("beside", k).bitwiseAND(F.lit((1 << bits) - 1).cast("long"))
    rests = [part(8, 8) * 256 + part(0, 8), part(16, 8) * 256 + part(8, 8), part(24, 8) * 256 + part(16, 8)]
    ways = F.explode(F.array(*(F.struct(F.lit(s).cast("long").alias("shift"), rest.alias("rest")) for s, rest in enumerate(rests))))
    placed = deep.withColumn("way", ways).withColumn("i", F.col("at").bitwiseAND(F.lit(65535).cast("long")) - F.col("way.shift")).filter((F.col("i") >= 0) & (F.col("i") < part(48, 15)))
    placed = placed.select("name", "way.shift", "way.rest", "t", (F.shiftright("at", 16) + F.col("i")).alias("at"), (F.col("beside") < 0).cast("long").alias("asked"))
    ordered, at = _sorted(placed, ("name", "shift", "rest"), ("t", "at"))

    # Adjacent in the order: a key of two places at least, or one that goes on over a partition's edge.
    runs = ordered.groupBy("part", "local").agg(F.count("*").alias("places")).join(F.broadcast(at), "part")
    same = runs.filter("places > 1 or goes_on and local = 0 or stays and local = top").select("part", "local")
    found = ordered.filter("asked = 1").join(written(same, "same"), ["part", "local"], "left_semi")
    return found.select("t", F.col("at").cast("int").alias("lo")).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(t, spans) with the spans of each text sorted, and joined where they meet."""
    kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        spans = [[{"begin": a, "end": b} for a, b in merged(0, False, x)] for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["t", "spans"])


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(t, copied, spans): for each distinct text with repeats, the (begin, end) byte ranges to remove, which
    may overlap; ``copied`` texts have equal rows and go wholly."""
    return _spans(Keys(docs))


def _spans(keys: Keys) -> DataFrame:
    keyed, copies = keys.texts, keys.copies
    runs = written(_runs(keyed), "runs", large=True)

    # Names with more than one place; open ones have different contexts. Both sides of each join are plain tables, so Spark can split a common name.
    several = written(runs.groupBy("m").agg(*_several("t", "lo"), (F.min("c1") != F.max("c1")).alias("open")).filter(_MANY).select("m", "open"), "several")
    every, runs = runs, written(runs.join(several, "m"), "candidates", large=True)
    discard(every, several)
    contexts = runs.groupBy("m", "c1", "c2", "n", "open").agg(*_several("t", "lo"))
    contexts = written(contexts.select("m", "c1", "c2", "n", "open", "t0", "at0", F.expr(_MANY).alias("copied")), "contexts")
    whole = runs.join(contexts.filter("copied").select("m", "c1", "c2", "n"), ["m", "c1", "c2", "n"], "left_semi").select("t", "lo", "n")
    whole = written(whole.join(copies, "t", "left_anti"), "whole")
    discard(runs)

    cut = written(_blocks(keyed, contexts.filter("open").select(F.col("t0").alias("t"), F.col("at0").alias("lo"), "n", "m", "copied")), "blocks", large=True)
    discard(contexts)
    hulls = cut.groupBy("core", "h1", "h2", "n").agg(*_several("t", "lo"), F.max("copied").alias("copied"))
    hulls = written(hulls.select("core", "h1", "h2", "n", "t0", "at0", F.expr(_MANY).alias("many"), "copied"), "hulls")
    blocks = written(cut.join(hulls.filter("many").select("core", "h1", "h2", "n"), ["core", "h1", "h2", "n"], "left_semi").select("t", "lo", "n"), "equal")
    discard(cut)

    undecided = hulls.groupBy("core").agg((F.count("*") > 1).alias("several"), F.max(~F.col("many") & ~F.col("copied")).alias("asked")).filter("several and asked").select("core")
    undecided = written(undecided, "undecided")
    left = hulls.join(undecided, "core", "left_semi").select(F.col("t0").alias("t"), F.col("at0").alias("lo"), "n", (~F.col("many") & ~F.col("copied")).cast("int").alias("asked"))
    left = written(left, "left")
    discard(hulls, undecided)
    single = written(_suffix_repeats(keyed, left).withColumn("n", F.lit(1)), "single")

    places = whole.union(blocks).union(single).join(copies, "t", "left_anti")
    spans = places.groupBy("t").agg(F.collect_list(F.struct(F.col("lo").alias("begin"), (F.col("lo") + F.col("n") + (LENGTH - 1)).alias("end"))).alias("spans"))
    spans = spans.mapInArrow(_joined, "t long, spans array<struct<begin:int,end:int>>")
    none = F.lit(None).cast("array<struct<begin:int,end:int>>")
    return spans.select("t", F.lit(False).alias("copied"), "spans").union(copies.select("t", F.lit(True), none))


def _with_spans(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """The rows of ``docs`` with two more columns, and their names: whether the text goes wholly, and the spans to remove."""
    with scratch() as kept:
        keys = Keys(docs)
        spans = written(_spans(keys), "spans")
        kept += [keys.twins, spans]
    size = spans.agg(F.count("*"), F.sum(F.coalesce(F.size("spans"), F.lit(0)))).first()
    small = size[0] <= BROADCAST_ROWS and (size[1] or 0) <= BROADCAST_SPANS
    key, other, copied, found = (free_name(x, docs.columns) for x in ("key_", "t_", "copied_", "spans_"))
    spans = spans.select(F.col("t").alias(other), F.col("copied").alias(copied), F.col("spans").alias(found))
    return keys.of(docs, key).join(F.broadcast(spans) if small else spans, F.col(key) == F.col(other), "left").drop(key, other), copied, found


def merged(size: int, copied: bool | None, spans: list | None) -> list[tuple[int, int]]:
    """Disjoint maximal (begin, end) in order."""
    if copied:
        return [(0, size)] if size >= LENGTH else []
    out: list[list[int]] = []
    for begin, end in sorted((s["begin"], s["end"]) for s in spans or ()):
        if out and begin <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([begin, end])
    return [(a, b) for a, b in out]


def kept(data: bytes, removed: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in removed for x in span), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2]))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with its text less the repeats (bytes of a cut character go too), and n_chars to match.

    Further columns stay as they are; a null text stays null.
    """
    rows, copied, found = _with_spans(docs)
    names = docs.columns
    at, chars = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns[:-2]
            wholly, spans, text = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1), columns[at]
            changed = {}
            for i, (whole, cut) in enumerate(zip(wholly, spans)):
                if text[i].is_valid and (whole or cut.is_valid and len(cut)):
                    data = str(text[i].as_py()).encode()
                    changed[i] = kept(data, merged(len(data), whole, cut.as_py())).decode("utf-8", "ignore")
            if changed:
                columns[at] = pa.array([changed[i] if i in changed else x.as_py() for i, x in enumerate(text)], text.type)
                if chars is not None:
                    columns[chars] = pa.array([len(changed[i]) if i in changed else x for i, x in enumerate(columns[chars].to_pylist())], columns[chars].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)
        trim()

    return in_arrow(rows.select(*(F.col(quoted(c)) for c in docs.columns), copied, found), run, docs.schema)


def digests(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, copied, spans in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3)):
                data = text.as_py()
                removed = merged(len(data), copied, spans.as_py())
                rows.append((len(data), sum(b - a for a, b in removed), len(removed), hashlib.sha256(kept(data, removed)).hexdigest()))
            columns = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows, copied, found = _with_spans(docs)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), copied, found)
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
