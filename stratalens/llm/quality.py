"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad; its evidence is what its bytes look like, what the neighbouring lines look like,
and whether it repeats an earlier line. The field is fitted on documents labelled as a whole (each line takes
its document's label), on runs of lines spread over each whole text. A document's quality is the mean of its lines'
forward-backward marginals, weighted by their lengths and calibrated on the sampled documents' whole texts. The tasks
turn a sampled text into the features of at most ``TRAIN_LINES`` lines, so some 10 MB at most come to the driver.

Defined cases: a null text is one empty line, and an empty text is too; lines of over ``PIECE`` bytes are
taken in pieces; without labels of both kinds every score is the share of label 1 (0.5 without any); rows of
``labels`` without a document or a quality teach nothing; repeated label rows and repeated ids count once, with
one of the id's texts.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, held_out, scratch, written

#: Labelled documents that training reads at most, the lines it takes from each, and how many of these follow each other.
TRAIN_ROWS, TRAIN_LINES, RUN = 3_000, 24, 8
STEPS, RATE, PENALTY = 150, 0.1, 1e-3
PIECE = 32_768
THRESHOLD = 0.3
#: Bytes of text handled at once.
CHUNK = 1 << 20

_CLASSES = [  # counted in each line
    bytes(range(65, 91)),
    bytes(range(97, 123)),
    bytes(range(128, 256)),
    b"0123456789",
    b"#*$%&<>=@_~^\\{}[]",
    b"|",
    b"!?",
    b" \t\r\x0b\x0c",
]


def _table(classes: list[bytes]) -> np.ndarray:
    """For each byte, a 1 in its class's 16-bit field."""
    out = np.zeros(256, np.uint64)
    for k, members in enumerate(classes):
        out[list(members)] = np.uint64(1 << (16 * k))
    return out


_TABLES = _table(_CLASSES[:4]), _table(_CLASSES[4:])


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines, features), the lines of each text, and each line's length in bytes."""
    lengths, counts, again, stutter = [], [], [], []
    for text in texts:
        seen: set[bytes] = set()
        n = 0
        for line in text.split(b"\n"):
            repeated = line in seen and len(line) > 0
            seen.add(line)
            for at in range(0, max(1, len(line)), PIECE):
                lengths.append(min(PIECE, len(line) - at) + (at + PIECE >= len(line)))  # with its line end
                again.append(repeated)
                words = line[at : at + PIECE].split()
                stutter.append(sum(map(operator.eq, words, words[1:])) / max(1, len(words)))
                n += 1
        counts.append(n)
    length = np.array(lengths, np.int64)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    begin = np.cumsum(length) - length
    counted = []
    for table in _TABLES:
        sums = np.add.reduceat(table[data], begin)
        counted += [((sums >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.float64) for k in range(4)]
    upper, lower, other, digits, symbols, bars, marks, spaces = counted
    size = np.maximum(1, length - 1).astype(np.float64)
    letters = upper + lower + other
    own = np.column_stack(
        [
            np.log1p(length),
            letters / size,
            upper / np.maximum(1, letters),
            other / size,
            digits / size,
            np.sqrt(symbols / size),
            np.sqrt(bars / size),
            np.sqrt(marks / size),
            (size - letters - digits - symbols - bars - marks - spaces) / size,
            np.log1p(np.minimum(100, (size - spaces) / (spaces + 1))),
            np.array(again, np.float64),
            np.sqrt(stutter),
        ]
    )
    near = own[:, [0, 2, 5, 6, 7, 10, 11]]
    last = np.cumsum(counts) - 1
    before, after = np.roll(near, 1, axis=0), np.roll(near, -1, axis=0)
    before[np.r_[0, last[:-1] + 1]] = 0
    after[last] = 0
    return np.column_stack([own, before, after]), np.array(counts), length


@dataclass
class Field:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray  # log potentials of (bad, good) to (bad, good)
    slope: float = 1.0
    base: float = 0.0
    #: The score of every document where there was nothing to learn from.
    constant: float | None = None

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Log odds of good of each line by itself."""
        return np.clip(((x - self.mean) / self.scale) @ self.weights + self.bias, -30, 30)

    def marginals(self, odds: list[float]) -> list[float]:
        """Probability of good of each line of one document, from the lines' own odds."""
        (bb, bg), (gb, gg) = np.exp(self.moves).tolist()
        forward, f = [], 0.0
        for t, u in enumerate(odds):
            f = u if t == 0 else u * (f * gg + bg) / (f * gb + bb)
            forward.append(f)
        back, out = 1.0, [0.0] * len(odds)
        for t in range(len(odds) - 1, -1, -1):
            o = forward[t] * back
            out[t] = o / (1 + o)
            o = odds[t] * back
            back = (gg * o + gb) / (bg * o + bb)
        return out

    def raw(self, texts: list[bytes]) -> np.ndarray:
        """Log odds of the documents' length-weighted mean marginals."""
        x, counts, length = line_features(texts)
        odds, out, at = np.exp(self.evidence(x)).tolist(), [], 0
        for n in counts.tolist():
            p = np.dot(self.marginals(odds[at : at + n]), length[at : at + n]) / length[at : at + n].sum()
            out.append(p)
            at += n
        p = np.clip(np.array(out), 1e-6, 1 - 1e-6)
        return np.log(p / (1 - p))

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.raw(texts) + self.base, -30, 30)))


def chains(text: bytes) -> list[np.ndarray]:
    """Features of runs of lines spread over a whole text; all lines of a short one."""
    x = line_features([text])[0]
    if len(x) <= TRAIN_LINES:
        return [x]
    starts = np.linspace(0, len(x) - RUN, TRAIN_LINES // RUN).astype(np.int64)
    return [x[i : i + RUN] for i in starts]


def gradient(z: np.ndarray, counts: np.ndarray, y: np.ndarray, w: np.ndarray, b: float, moves: np.ndarray) -> list[np.ndarray]:
    """Of the mean negative log-likelihood of the lines (without penalty): by weights, bias and moves. z: lines' features; counts and
    y: the lines and the label of each chain."""
    steps = int(counts.max())
    row, col = np.repeat(np.arange(len(y)), counts), np.arange(len(z)) - np.repeat(np.cumsum(counts) - counts, counts)
    pair = np.arange(1, steps)[None, :] < counts[:, None]
    score = np.zeros((len(y), steps))
    score[row, col] = np.clip(z @ w + b, -30, 30)
    a = np.zeros((len(y), steps, 2))  # normalised forward messages, (bad, good)
    back = np.ones((len(y), steps, 2))
    unary = np.stack([np.ones_like(score), np.exp(score)], axis=2)
    unary /= unary.sum(axis=2, keepdims=True)
    m = np.exp(moves)
    a[:, 0] = unary[:, 0]
    for t in range(1, steps):
        a[:, t] = (a[:, t - 1] @ m) * unary[:, t]
        a[:, t] /= a[:, t].sum(axis=1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        back[:, t] = (unary[:, t + 1] * back[:, t + 1]) @ m.T
        back[:, t] = np.where(pair[:, t, None], back[:, t] / back[:, t].sum(axis=1, keepdims=True), 1)
    p = a * back
    p /= p.sum(axis=2, keepdims=True)
    joint = a[:, :-1, :, None] * m[None, None] * (unary * back)[:, 1:, None, :]
    joint /= joint.sum(axis=(2, 3), keepdims=True)
    expected = (joint * pair[:, :, None, None]).sum(axis=(0, 1))
    observed = np.diag([(pair.sum(axis=1) * (1 - y)).sum(), (pair.sum(axis=1) * y).sum()])
    off = p[row, col, 1] - y[row]
    return [z.T @ off / len(z), np.array([off.mean()]), (expected - observed) / len(z)]


def fit_chains(x: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> Field:
    """Full-batch Adam on the penalised log-likelihood of chains of lines; deterministic for the same rows."""
    y = np.asarray(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Field(np.zeros(1), np.ones(1), np.zeros(1), 0.0, np.zeros((2, 2)), constant=float(y.mean()) if len(y) else 0.5)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / scale
    params = [np.zeros(z.shape[1]), np.zeros(1), np.zeros((2, 2))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, STEPS + 1):
        grads = gradient(z, counts, y, params[0], float(params[1][0]), params[2])
        grads = [grads[0] + PENALTY * params[0], grads[1], grads[2] + PENALTY * params[2]]
        for q, g, (m1, m2) in zip(params, grads, moments):
            m1 += 0.1 * (g - m1)
            m2 += 0.001 * (g * g - m2)
            q -= RATE * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Field(mean, scale, params[0], float(params[1][0]), params[2])


def calibrate(field: Field, raw: np.ndarray, labels: np.ndarray) -> None:
    """Newton steps of a logistic calibration on whole documents' log odds."""
    y = np.asarray(labels, np.float64)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(field.slope * raw + field.base, -30, 30)))
        d = np.column_stack([raw, np.ones_like(raw)])
        h = (d * (p * (1 - p))[:, None]).T @ d + 1e-3 * np.eye(2)
        field.slope, field.base = np.array([field.slope, field.base]) - np.linalg.solve(h, d.T @ (p - y) + 1e-3 * np.array([field.slope - 1, field.base]))


def fit(texts: list[bytes], labels: list[int]) -> Field:
    """The field of a few texts at hand, as ``train`` fits it of a table."""
    parts = [(x, label) for text, label in zip(texts, labels) for x in chains(text)]
    field = fit_chains(np.concatenate([x for x, _ in parts]), np.array([len(x) for x, _ in parts]), np.array([label for _, label in parts]))
    if field.constant is None:
        calibrate(field, field.raw(texts), np.array(labels))
    return field


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Field:
    """Learn from at most ``rows`` labelled documents that aren't held out, in hash order."""
    known = labels.filter(F.col("quality").isin(0, 1) & ~held_out()).select("doc_id", F.col("quality").cast("int").alias("quality"))
    sample = bounded_sample(known, "doc_id", rows, "doc_id", "quality")
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    one = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    with scratch():
        one = written(one, "labelled")

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(q, len(x), x.astype("<f4").tobytes()) for q, t in zip(batch.column(0).to_pylist(), batch.column(1)) for x in chains(t.as_py())]
                columns = list(zip(*out)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["quality", "lines", "features"])

        got = sorted((r["quality"], r["lines"], bytes(r["features"])) for r in one.select("quality", "text").mapInArrow(spread, "quality int, lines int, features binary").collect())
        if not got:
            return fit_chains(np.zeros((0, 1)), np.zeros(0, np.int64), np.zeros(0))
        counts = np.array([n for _, n, _ in got])
        x = np.frombuffer(b"".join(f for *_, f in got), "<f4").reshape(int(counts.sum()), -1).astype(np.float64)
        field = fit_chains(x, counts, np.array([q for q, _, _ in got]))
        if field.constant is not None:
            return field

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = [float(field.raw([t.as_py()])[0]) for t in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(raw, pa.float64())], names=["quality", "raw"])

        pairs = np.array(sorted((r["quality"], r["raw"]) for r in one.select("quality", "text").mapInArrow(judge, "quality int, raw double").collect()))
        calibrate(field, pairs[:, 1], pairs[:, 0])
        return field


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    field = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, part, size = [], [], 0
            for text in batch.column(1):
                part.append(text.as_py())
                size += len(part[-1])
                if size >= CHUNK:
                    out.append(field.score(part))
                    part, size = [], 0
            if part:
                out.append(field.score(part))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    scored = docs.select("doc_id", text.alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
