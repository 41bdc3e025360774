"""Packing of tokenised documents into fixed-length sequences.

A document becomes ``ids + [end]``. Every full window of ``capacity`` ids is a sequence of its own; the
rest of each document (one piece) is packed with the rests of other documents by first-fit decreasing. A
tournament tree over the bins' free room finds the first bin that fits in O(log bins). Bins are packed
independently inside randomised groups of a bounded number of documents, so nothing global is needed:
token ids never leave the task that made them, only piece lengths and checksums are shuffled.

Defined cases: a null or empty text is the end id alone; a null ``doc_id`` is packed like any other; equal
rows are packed once each; an empty table gives no rows. Further input columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64

CAPACITY = 1024
END_ID = 0
#: Documents expected in one group; a group is packed in one task and takes some 100 bytes a piece.
GROUP_DOCS = 4096

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids of whole texts from a byte-level BPE tokenizer file.

    Where the file is plain byte-level BPE with its ids in merge order, tiktoken merges its vocabulary (some five
    times as fast, same ids). Texts with the tokenizer's special strings, and other files, are left to tokenizers.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.merge = merger(path)

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if self.merge is None or any(s in text for s in self.special):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.frombuffer(self.merge.encode_to_numpy(text, disallowed_special=()), "<u4").tobytes()


def merger(path: str):
    """tiktoken's encoder over the vocabulary of a tokenizers file, or None where that would give other ids."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    model, before = file["model"], file.get("pre_tokenizer") or {}
    plain = model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    words = before.get("type") == "ByteLevel" and not before.get("add_prefix_space", True) and before.get("use_regex", True)
    after = (file.get("post_processor") or {}).get("type", "ByteLevel") == "ByteLevel"
    if not (plain and words and after) or file.get("normalizer") or file.get("truncation") or file.get("padding"):
        return None
    vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    # Byte-level files write bytes that don't print as the characters from 256 on.
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*plain}))}
    ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if i < 256 + len(merges)}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenised(docs: DataFrame, path: str, capacity: int, groups: int) -> DataFrame:
    """Per row of ``docs``: doc_id, doc_tokens, the checksum of each piece, and its random group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(path), np.array([END_ID], "<u4").tobytes()
        part = np.uint64(TaskContext.get().partitionId() << 40)
        for batch in batches:
            ids, texts, row = batch.column(0), batch.column(1).to_pylist(), np.asarray(batch.column(2)).view(np.uint64)
            tokens, crcs = [], []
            for text in texts:
                data = (encoder.encode(text) if text else b"") + end
                tokens.append(len(data) // 4)
                crcs.append([zlib.crc32(data[i : i + 4 * capacity]) for i in range(0, len(data), 4 * capacity)])
            # The group comes from what the row holds, whatever order a task meets its rows in; equal rows are told apart by number.
            order = np.argsort(row, kind="stable")
            begins = np.r_[True, row[order][1:] != row[order][:-1]]
            nth = np.empty(len(row), np.uint64)
            nth[order] = np.arange(len(row)) - np.maximum.accumulate(np.where(begins, np.arange(len(row)), 0))
            row = mix64(row) + mix64(nth + part)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(tokens, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array((mix64(row) % np.uint64(groups)).astype(np.int64))],
                names=["doc_id", "doc_tokens", "crcs", "grp"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("row", F.xxhash64("doc_id", "text")).mapInArrow(run, "doc_id long, doc_tokens long, crcs array<long>, grp long")


class Tournament:
    """Free room of bins in order: a complete binary tree whose inner nodes hold their children's maximum."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put ``size`` into the first bin with room for it; every size fits some bin."""
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        at = node - self.leaves
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return at


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each item, and its offset there. Ties keep the given order."""
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    tree, used = Tournament(len(sizes), capacity), [0] * len(sizes)
    for i in np.argsort(-sizes, kind="stable"):
        size = int(sizes[i])
        bins[i] = at = tree.place(size)
        offsets[i] = used[at]
        used[at] += size
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    path = tokenizer or default_tokenizer()
    groups = max(1, -(-docs.count() // group_docs))

    def of_group(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("doc_tokens", "ascending"), ("doc_id", "ascending")]))
        tokens = rows["doc_tokens"].to_numpy()
        full, rest = tokens // capacity, tokens % capacity
        with_rest = np.flatnonzero(rest)
        bins, offsets = first_fit_decreasing(rest[with_rest], capacity)
        used = int(bins.max()) + 1 if len(bins) else 0
        pieces = full + (rest > 0)
        doc = np.repeat(np.arange(len(rows)), pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        is_full = nth < full[doc]
        sequence, offset = np.zeros(len(doc), np.int64), np.zeros(len(doc), np.int64)
        sequence[is_full] = used + np.arange(int(is_full.sum()))
        sequence[~is_full], offset[~is_full] = bins, offsets
        return pa.table(
            {
                "doc_id": rows["doc_id"].take(pa.array(doc)),
                "start": nth * capacity,
                "length": np.where(is_full, capacity, rest[doc]),
                "ids_crc32": pc.list_flatten(rows["crcs"]),
                "doc_tokens": tokens[doc],
                "sequence_id": sequence + (key[0].as_py() << 32),
                "offset": offset,
            }
        )

    return tokenised(docs, path, capacity, groups).groupBy("grp").applyInArrow(of_group, _PIECES)
