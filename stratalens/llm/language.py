"""Language identification with a byte convolutional network.

Texts are cut into fixed-length windows of UTF-8 bytes. Filters of several widths slide over each window;
their outputs are max-pooled, and a softmax over the pooled features gives the window's languages. A
document's probabilities are the mean over all its windows, weighted by their bytes. Training is plain
numpy on a bounded sample of labelled rows, as many of each language, and of windows spread over their whole texts;
inference scores the windows of many documents at once.

A filter over one-hot bytes is a table lookup, so the first layer costs a few gathers a byte: filters of
even width read tables of byte pairs.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; without a labelled row every
document is ``und``; rows with a null label are no training data; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, held_out, in_arrow, quoted, scratch, stratified_sample, trim

WINDOW = 256
WIDTHS = (2, 4, 6)
FILTERS = 16
#: Labelled rows that training reads at most, and the windows it takes from each.
TRAIN_ROWS, TRAIN_WINDOWS = 2_000, 4
EPOCHS, BATCH, RATE = 6, 64, 0.01
#: Windows scored at once, and bytes of text cut into windows at once.
WINDOWS_AT_ONCE, BYTES_AT_ONCE = 256, 1 << 19
#: Share of the probability under which a document's language counts as not recognised.
ACCEPT = 0.35


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows (rows of WINDOW bytes, padded with spaces), the text of each, and its number of bytes."""
    counts = np.array([-(-len(t) // WINDOW) for t in texts], np.int64)
    out = np.full((int(counts.sum()), WINDOW), 32, np.uint8)
    flat, at = out.reshape(-1), 0
    for t, n in zip(texts, counts.tolist()):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * WINDOW
    owner = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    sizes = np.minimum(WINDOW, np.array([len(t) for t in texts], np.int64)[owner] - nth * WINDOW) if len(owner) else np.zeros(0, np.int64)
    return out, owner, sizes


@dataclass
class Network:
    languages: list[str]
    tables: list[np.ndarray]  # of each width: (width, 256, filters)
    biases: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def __post_init__(self) -> None:
        self.pairs: list[list[np.ndarray]] | None = None

    def pooled(self, x: np.ndarray, places: bool = False) -> tuple[np.ndarray, list[np.ndarray]]:
        """Max-pooled filter outputs of windows, and where the maxima lie."""
        if self.pairs is None:
            self.pairs = [[(t[i][:, None, :] + t[i + 1][None, :, :]).reshape(65536, -1).astype(np.float32) for i in range(0, len(t), 2)] for t in self.tables]
        pair = x[:, :-1].astype(np.int32) * 256 + x[:, 1:]
        out, at = [], []
        for tables, bias in zip(self.pairs, self.biases):
            n = pair.shape[1] - 2 * (len(tables) - 1)
            total = tables[0][pair[:, :n]]
            for i, table in enumerate(tables[1:], 1):
                total += table[pair[:, 2 * i : 2 * i + n]]
            out.append(np.maximum(total.max(axis=1) + bias, 0))
            if places:
                at.append(total.argmax(axis=1))
        return np.concatenate(out, axis=1), at

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        parts = [self.pooled(x[i : i + WINDOWS_AT_ONCE])[0] for i in range(0, len(x), WINDOWS_AT_ONCE)]
        scores = np.concatenate(parts) @ self.weights + self.bias if parts else np.zeros((0, len(self.languages)))
        scores = np.exp(scores - scores.max(axis=1, keepdims=True)) if len(scores) else scores
        return scores / scores.sum(axis=1, keepdims=True) if len(scores) else scores

    def score(self, texts: list[bytes]) -> np.ndarray:
        """(texts, languages) mean probabilities; zeros for an empty text."""
        x, owner, sizes = windows(texts)
        p = self.probabilities(x) * sizes[:, None]
        out = np.zeros((len(texts), len(self.languages)))
        np.add.at(out, owner, p)
        return out / np.maximum(1, np.array([len(t) for t in texts]))[:, None]


def fit(texts: list[bytes], labels: list[str], seed: int = 0) -> Network:
    """Adam on the cross-entropy of windows; deterministic for the same rows."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    x, owner, _ = windows(texts)
    y = np.array([languages.index(v) for v in labels])[owner]
    net = Network(
        languages,
        [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS],
        [np.zeros(FILTERS, np.float32) for _ in WIDTHS],
        rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    share = np.bincount(y, minlength=len(languages)) / max(1, len(y))
    weight = 1 / (len(languages) * share[y])  # each language counts the same
    params = [*net.tables, *net.biases, net.weights, net.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(x))
        for begin in range(0, len(x), BATCH):
            take = order[begin : begin + BATCH]
            net.pairs, step = None, step + 1
            rows = x[take]
            out, at = _train_pooled(net, rows)
            scores = out @ net.weights + net.bias
            scores = np.exp(scores - scores.max(axis=1, keepdims=True))
            scores /= scores.sum(axis=1, keepdims=True)
            scores[np.arange(len(take)), y[take]] -= 1
            scores *= (weight[take] / len(take))[:, None]
            back = (scores @ net.weights.T) * (out > 0)
            grads = [np.zeros_like(t) for t in net.tables]
            for k, width in enumerate(WIDTHS):
                part = back[:, k * FILTERS : (k + 1) * FILTERS]
                for i in range(width):
                    np.add.at(grads[k][i], (np.take_along_axis(rows, at[k] + i, axis=1), np.arange(FILTERS)[None, :]), part)
            grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(axis=0) for k in range(len(WIDTHS))]
            grads += [out.T @ scores, scores.sum(axis=0)]
            for p, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.pairs = None
    return net


def _train_pooled(net: Network, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """As ``pooled``, from the small tables, which change with every step."""
    out, at = [], []
    for table, bias in zip(net.tables, net.biases):
        n = x.shape[1] - len(table) + 1
        total = table[0][x[:, :n]].copy()
        for i in range(1, len(table)):
            total += table[i][x[:, i : i + n]]
        at.append(total.argmax(axis=1))
        out.append(np.maximum(total.max(axis=1) + bias, 0))
    return np.concatenate(out, axis=1), at


def spread(text: Column) -> Column:
    """``TRAIN_WINDOWS`` windows of a text's bytes from its beginning to its end; all of a shorter text."""
    data = text.cast("binary")
    size = F.octet_length(data)
    starts = [F.floor((size - WINDOW) * k / (TRAIN_WINDOWS - 1)).cast("int") + 1 for k in range(TRAIN_WINDOWS)]
    return F.when(size <= TRAIN_WINDOWS * WINDOW, data).otherwise(F.concat(*(F.substring(data, at, F.lit(WINDOW)) for at in starts)))


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Network | None:
    """Learn from at most ``rows`` labelled rows that aren't held out, an even share for each language, in hash order."""
    text = F.col("text").cast("string")
    labelled = docs.filter(F.col("lang").isNotNull() & text.rlike(r"\p{L}") & ~held_out()).select("doc_id", F.col("lang").cast("string").alias("lang"), spread(text).alias("text"))
    with scratch():
        sample = stratified_sample(labelled, "lang", "doc_id", rows, "text").select("lang", "text").collect()
    return fit([bytes(r["text"]) for r in sample], [r["lang"] for r in sample]) if sample else None


def identify(docs: DataFrame, model: Network | None, names: tuple[str, str] = ("lang_pred", "lang_score")) -> DataFrame:
    """The rows of ``docs`` with the predicted language and its score, under names that ``docs`` has no column of."""

    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(batch.num_columns - 1).to_pylist()
            langs, scores = ["und"] * len(asked), np.zeros(len(asked))
            rows, texts, size = [], [], 0

            def judge() -> None:
                for i, p in zip(rows, model.score(texts)):
                    langs[i], scores[i] = model.languages[int(p.argmax())], min(1.0, float(p.max()))

            for i, text in enumerate(batch.column(at)):
                if not asked[i]:
                    continue
                rows.append(i)
                texts.append(str(text.as_py()).encode())
                size += len(texts[-1])
                if size >= BYTES_AT_ONCE:
                    judge()
                    rows, texts, size = [], [], 0
            if rows:
                judge()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names[:-1], *names])
        trim()

    if {c.lower() for c in docs.columns} & {c.lower() for c in names}:
        raise ValueError(f"columns of the input are called {names}")
    if model is None:
        return docs.withColumn(names[0], F.lit("und")).withColumn(names[1], F.lit(0.0))
    text = F.col("text").cast("string")
    scored = docs.withColumn(free_name("letters_", docs.columns), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)))
    return in_arrow(scored, run, T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]))


def predictions(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    out = identify(docs.select(F.col("doc_id"), "text"), train(docs))
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def recognised(docs: DataFrame) -> DataFrame:
    """``docs`` without the rows in which no language is recognised, under their own columns.

    Where no row has a language to learn from, none can be told: all rows stay.
    """
    lang, score = (free_name(x, docs.columns) for x in ("lang_pred", "lang_score"))
    model = train(docs)
    if model is None:
        return docs
    out = identify(docs, model, (lang, score))
    return out.filter((F.col(lang) != "und") & (F.col(score) >= ACCEPT)).select(*(F.col(quoted(c)) for c in docs.columns))
