"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Word n-grams of the benchmark items are looked for in every document, and each place that holds one, however
frequent it is, joins a passage to its items (a bound on a seed's frequency loses the copies of items that are edited and
frequent). A passage with too few of an item's words to reach the threshold goes;
every other one is aligned with its item word by word, and the local alignment's score, as a share of a verbatim
copy's, finds edited and paraphrased copies.

The benchmark's distinct texts go to the tasks in blocks of ``CHARS_A_PASS`` characters; a larger benchmark takes more passes, each
written before the next one's block is sent. Items of one text meet its finds in a join.

A passage is a union of whole stretches, and each stretch holds all that the alignment around one diagonal may use (the item's length
and a quarter on both sides), so where a passage ends (at eight lengths of the item) no alignment within a stretch is cut.

Defined cases: words are runs of letters, digits and underscores of the lower-cased text; a null or empty
text has none; items without words match nothing; items shorter than the n-gram are one seed; repeated
items or documents give a row each, whatever their ids; empty tables give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, in_arrow, mix64, trim, written

NGRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of a verbatim copy's score from which a passage is a copy.
THRESHOLD = 0.5
#: Characters of items in one pass over the documents (more if one item is longer); their words and seeds are sent to each task.
CHARS_A_PASS = 4_000_000
#: Items up to which their ids are broadcast (40 bytes each); beyond it finds and ids are shuffled.
BROADCAST_ROWS = 200_000
#: Places of seeds in a text handled at once.
PLACES = 1 << 18
#: Cells of an alignment table handled at once.
CELLS = 1 << 20

_WORD = re.compile(r"\w+")


class Index:
    """Words and seeds of a block of items: seeds sorted by hash, with their item and place there."""

    def __init__(self, items: list[tuple[bytes, str]]):
        self.keys = [key for key, _ in items]
        texts = [_WORD.findall(t.lower()) for _, t in items]
        self.words = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}), 1)}
        self.items = [np.array([self.words[w] for w in t], np.int64) for t in texts]
        self.lengths = np.array([len(x) for x in self.items], np.int64)
        self.seeds: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in {min(NGRAM, n) for n in self.lengths.tolist() if n}:
            mine = [k for k, n in enumerate(self.lengths.tolist()) if min(NGRAM, n) == size]
            seeds = [self.hashes(self.items[k], size) for k in mine]
            counts = [len(x) for x in seeds]
            seed, item, at = np.concatenate(seeds), np.repeat(mine, counts), np.concatenate([np.arange(n) for n in counts])
            order = np.argsort(seed, kind="stable")
            self.seeds[size] = seed[order], item[order], at[order]

    @staticmethod
    def hashes(words: np.ndarray, size: int) -> np.ndarray:
        """Of each ``size`` words in turn; 0 where one of them is unknown."""
        if len(words) < size:
            return np.zeros(0, np.uint64)
        total, known = np.zeros(len(words) - size + 1, np.uint64), np.ones(len(words) - size + 1, bool)
        for i in range(size):
            part = words[i : len(words) - size + 1 + i]
            known &= part > 0
            total = total * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64)
        return np.where(known, mix64(total) | np.uint64(1), np.uint64(0))

    def coded(self, text: str) -> np.ndarray:
        get = self.words.get
        return np.array([get(w, 0) for w in _WORD.findall(text.lower())], np.int64)

    def hits(self, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item number, where the item's first word would lie) of the seeds in a text, a bounded number at once."""
        for size, (seeds, item, at) in self.seeds.items():
            h = self.hashes(words, size)
            where = np.flatnonzero(h)
            low, high = (np.searchsorted(seeds, h[where], side) for side in ("left", "right"))
            where, low, counts = where[high > low], low[high > low], (high - low)[high > low]
            ends = np.cumsum(counts)
            begin = 0
            while begin < len(where):
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PLACES, "right")))
                n = counts[begin:end]
                places = np.repeat(low[begin:end] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                yield item[places], np.repeat(where[begin:end], n) - at[places]
                begin = end

    def passages(self, words: np.ndarray) -> list[tuple[int, int, int]]:
        """(item number, begin, end) of the stretches of a text around seeds."""
        spans = np.zeros((0, 2), np.int64)
        for item, first in self.hits(words):  # seeds of one diagonal ask for the same stretch
            spans = np.unique(np.concatenate([spans, np.column_stack([item, first])]), axis=0)
        if not len(spans):
            return []
        item, first = spans.T
        pad = self.lengths[item] // 4 + NGRAM
        begins, ends = np.maximum(0, first - pad), np.minimum(len(words), first + self.lengths[item] + pad)
        out, now = [], None
        for k, b, e in zip(item.tolist(), begins.tolist(), ends.tolist()):
            if now is None or k != now[0] or b > now[2] or e - now[1] > 8 * (int(self.lengths[k]) + NGRAM):  # a new passage
                out.append(now)
                now = [k, b, e]
            now[2] = max(now[2], e)
        return [tuple(x) for x in [*out[1:], now] if self.reachable(x[0], words[x[1] : x[2]])]

    def reachable(self, k: int, passage: np.ndarray) -> bool:
        """Whether the item's words in a passage could score enough, were they all matched."""
        has = set(passage.tolist())
        return sum(w in has for w in self.items[k].tolist()) >= THRESHOLD * len(self.items[k])


def align(items: list[np.ndarray], passages: list[np.ndarray]) -> np.ndarray:
    """Smith-Waterman local alignment scores (linear gaps) of pairs of word numbers, all at once."""
    rows, cols = max(map(len, items)), max(map(len, passages))
    a, b = np.full((len(items), rows), -1, np.int64), np.full((len(items), cols), -2, np.int64)
    for i, (x, y) in enumerate(zip(items, passages)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    ramp = -GAP * np.arange(cols + 1, dtype=np.int32)
    last, best = np.zeros((len(items), cols + 1), np.int32), np.zeros(len(items), np.int32)
    for i in range(rows):
        now = np.zeros_like(last)
        step = np.where(a[:, i, None] == b, MATCH, MISMATCH).astype(np.int32)
        now[:, 1:] = np.maximum(np.maximum(last[:, :-1] + step, last[:, 1:] + GAP), 0)
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp  # gaps along the passage
        best = np.maximum(best, now.max(axis=1))
        last = now
    return best


def _found(index: Index, texts: list[str | None]) -> list[tuple[int, int, float]]:
    """(number of the text, number of the item, score) of each text that holds a copy of an item."""
    best: dict[tuple[int, int], float] = {}
    waiting: list[tuple[int, int, np.ndarray]] = []
    widest = 0

    def score() -> None:
        for (row, k, _), points in zip(waiting, align([index.items[k] for _, k, _ in waiting], [w for *_, w in waiting])):
            share = float(points) / (MATCH * len(index.items[k]))
            if share >= THRESHOLD:
                best[row, k] = max(best.get((row, k), share), share)
        waiting.clear()

    for row, text in enumerate(texts):
        words = index.coded(text) if text else np.zeros(0, np.int64)
        for k, begin, end in index.passages(words) if len(words) else ():
            widest = max(widest, end - begin)
            if waiting and (len(waiting) + 1) * (widest + 1) > CELLS:  # a table has a row of the widest passage for each pair
                score()
                widest = end - begin
            waiting.append((row, k, words[begin:end]))
    if waiting:
        score()
    return [(row, k, share) for (row, k), share in sorted(best.items())]


def _texts(benchmark: DataFrame) -> DataFrame:
    """(text_key, item_id, text) of the items with a text."""
    text = F.col("text").cast("string")
    return benchmark.select(F.unhex(F.sha2(text, 256)).alias("text_key"), F.col("item_id").cast("long").alias("item_id"), text.alias("text")).filter("text is not null")


def _blocks(items: DataFrame) -> Iterator[tuple]:
    """Broadcast indexes of blocks of distinct texts, and whether there is only one.

    Texts are dealt to buckets by hash, many for each block, and buckets go to blocks in order until one is full.
    """
    spark = items.sparkSession
    texts = items.groupBy("text_key").agg(F.first("text").alias("text"))
    chars = int(texts.agg(F.sum(F.length("text"))).first()[0] or 0)
    bucket = F.pmod(F.xxhash64("text_key"), F.lit(64 * max(1, -(-chars // CHARS_A_PASS))))
    blocks, full = [[]], 0
    for nth, size in sorted(texts.groupBy(bucket.alias("bucket")).agg(F.sum(F.length("text")).alias("chars")).collect()):  # 64 rows a pass
        if full and full + size > CHARS_A_PASS:
            blocks, full = [*blocks, []], 0
        blocks[-1].append(nth)
        full += size
    for mine in filter(None, blocks):
        rows = texts.filter(bucket.between(mine[0], mine[-1])).orderBy("text_key").collect()  # a block's texts
        yield spark.sparkContext.broadcast(Index([(bytes(r["text_key"]), r["text"]) for r in rows])), len(blocks) == 1


def copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, score) of each document that holds a copy of an item; score is 1 for a verbatim one."""
    id_kind = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", id_kind), T.StructField("text_key", T.BinaryType()), T.StructField("score", T.DoubleType())])

    def of(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                found = _found(index, batch.column(1).to_pylist())
                rows, items, scores = zip(*found) if found else ((), (), ())
                ids = batch.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([index.keys[k] for k in items], pa.binary()), pa.array(scores, pa.float64())], names=["doc_id", "text_key", "score"])
            trim()

        return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema)

    items = _texts(benchmark)
    out = docs.sparkSession.createDataFrame([], schema)
    for shared, only in _blocks(items):
        found = of(shared)
        if not only:
            found = written(found, "copies")
            shared.unpersist()
        out = found if only else out.union(found)
    named = items.select("text_key", "item_id")
    named = F.broadcast(named) if named.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else named
    return out.join(named, "text_key").select("doc_id", "item_id", "score")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that hold a copy of a benchmark item."""
    at = docs.columns.index("text")

    def of(rows: DataFrame, shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                stays = np.ones(len(batch), bool)
                stays[[row for row, *_ in _found(index, batch.column(at).cast(pa.string()).to_pylist())]] = False
                yield batch.filter(pa.array(stays))
            trim()

        return in_arrow(rows, run, docs.schema)

    last = None
    for shared, only in _blocks(_texts(benchmark)):
        docs = of(docs, shared)
        if not only:  # a pass's table goes as the next one stands
            docs = written(docs, "clean", large=True)
            shared.unpersist()
            if last is not None:
                discard(last)
            last = docs
    return docs
