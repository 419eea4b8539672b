"""A quality score from random-indexing word vectors and a small network.

Words are runs of letters and digits or of other signs, with their case, hashed
into ``BUCKETS`` rows. Every row has a fixed random index vector with a few +1 and
-1; a word's vector is the sum of the index vectors of the words beside it, over
all documents, brought to unit length. A text is pooled to the mean and the
spread of its words' vectors and a few rates (repeats of the previous word, odd
signs, capitals, length). Two layers in numpy turn this into a logit, and one
temperature, fitted on rows that training did not see, into a probability.

Context sums are formed per task and added up as columns in Spark, over all
rows; the table of sums has a fixed size. The network is fitted on the driver
from at most ``sample`` labelled rows, chosen by a hash of the id: the only bound.
Texts are always pooled whole.

Defined results: null, empty and blank texts are pooled to zeros and get the
score of that; null ids are scored and never learnt from; rows with several
labels count with their mean; a null label is none; without labels of both kinds
every score is the mean label (0.5 if there are none); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm import words

BUCKETS = 1 << 12
DIM = 48
NEAR = 2  # words on each side that count as context
RATES = 6
WIDTH = 2 * DIM + RATES
_MARKS = 6  # +1 and -1 in an index vector


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """For each row the places of its marks, and their signs."""
    rng = np.random.default_rng(seed)
    at = np.stack([rng.choice(DIM, _MARKS, replace=False) for _ in range(BUCKETS)])
    return at, rng.choice([-1.0, 1.0], (BUCKETS, _MARKS))


def tokens(texts: pa.Array) -> words.Words:
    """Words and runs of signs; a space goes in wherever one kind meets the other."""
    spread = pc.replace_substring_regex(
        texts.cast(pa.large_string()).fill_null(""), r"([!-/:-@\[-`{-~]+)", r" \1 "
    )
    return words.words(spread, words.byte_table(b" \t\n\x0b\x0c\r", lower=False))


def _rows(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(52)).astype(np.int64)


def context_sums(found: words.Words, into: np.ndarray, at: np.ndarray, sign: np.ndarray) -> None:
    """Add to ``into`` (flat, BUCKETS x DIM) the index vectors beside each word."""
    rows, owner = _rows(found.hashes), found.owner()
    for step in range(1, NEAR + 1):
        if len(rows) <= step:
            return
        same = owner[step:] == owner[:-step]
        left, right = rows[:-step][same], rows[step:][same]
        for j in range(_MARKS):
            for word, beside in ((left, right), (right, left)):
                into += np.bincount(
                    word * DIM + at[beside, j], weights=sign[beside, j], minlength=len(into)
                )


def _task_context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text) -> one row per bucket that occurs, with its sums in this task."""
    at, sign = index_vectors()
    total = np.zeros(BUCKETS * DIM)
    for batch in words.slices(batches, "text"):
        context_sums(tokens(batch.column(0)), total, at, sign)
    total = total.reshape(BUCKETS, DIM)
    some = np.flatnonzero(np.abs(total).sum(axis=1))
    if len(some):
        yield pa.RecordBatch.from_arrays(
            [pa.array(some.astype(np.int32)), *[pa.array(total[some, j]) for j in range(DIM)]],
            names=["bucket", *[f"d{j}" for j in range(DIM)]],
        )


def word_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Unit context vectors (BUCKETS x DIM) over all texts."""
    names = [f"d{j}" for j in range(DIM)]
    sums = (
        docs.select(F.col(text_col).alias("text"))
        .mapInArrow(_task_context, "bucket int, " + ", ".join(f"{n} double" for n in names))
        .groupBy("bucket")
        .agg(*[F.sum(n).alias(n) for n in names])
        .toPandas()
    )
    out = np.zeros((BUCKETS, DIM), np.float32)
    if len(sums):
        found = sums[names].to_numpy()
        norm = np.linalg.norm(found, axis=1, keepdims=True)
        out[sums["bucket"].to_numpy()] = found / np.where(norm > 0, norm, 1)
    return out


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """One row per text: mean and spread of its vectors, and rates."""
    found = tokens(texts)
    n = len(found)
    size = np.diff(found.offsets).astype(np.float64)
    out = np.zeros((n, WIDTH))
    full = np.flatnonzero(size)
    if not len(full):
        return out
    starts = found.offsets[:-1][full]
    rows = _rows(found.hashes)
    total, square = np.zeros((n, DIM)), np.zeros((n, DIM))
    step, owner = 1 << 17, found.owner()
    for at in range(0, len(rows), step):  # a bounded part of the words at a time
        part, own = vectors[rows[at : at + step]], owner[at : at + step]
        edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        total[own[edge]] += np.add.reduceat(part, edge, axis=0)
        square[own[edge]] += np.add.reduceat(part * part, edge, axis=0)
    mean = total[full] / size[full, None]
    out[full, :DIM] = mean
    out[full, DIM : 2 * DIM] = np.sqrt(np.maximum(square[full] / size[full, None] - mean**2, 0))
    same = np.zeros(len(rows))
    same[1:] = (found.hashes[1:] == found.hashes[:-1]) & (owner[1:] == owner[:-1])
    plain = texts.cast(pa.large_string()).fill_null("")
    length = np.maximum(pc.utf8_length(plain).to_numpy(), 1)
    rate = lambda pattern: pc.count_substring_regex(plain, pattern).to_numpy() / length
    distinct = np.array([len(np.unique(found.of(i))) for i in full])
    out[full, 2 * DIM] = np.add.reduceat(same, starts) / size[full]
    out[full, 2 * DIM + 1] = distinct / size[full]
    out[full, 2 * DIM + 2] = np.log1p(size[full]) / 10
    out[:, 2 * DIM + 3] = rate(r"[!-/:-@\[-`{-~]") * 10
    out[:, 2 * DIM + 4] = rate(r"\p{Lu}")
    out[:, 2 * DIM + 5] = rate(r"[0-9]") * 10
    return out


@dataclass
class Network:
    """Standardise, one hidden layer, one logit, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    layers: list[np.ndarray]
    temperature: float
    constant: float | None = None

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 400, seed: int = 3) -> Network:
    """Train on four fifths by Adam, stop early and fit the temperature on the rest."""
    if not len(y) or y.min() == y.max():
        return Network(np.zeros(WIDTH), np.ones(WIDTH), [], 1.0, float(y.mean()) if len(y) else 0.5)
    rng = np.random.default_rng(seed)
    held = rng.random(len(y)) < 0.2
    if held.all() or not held.any():
        held = np.arange(len(y)) % 2 == 0
    mean, scale = x[~held].mean(axis=0), x[~held].std(axis=0) + 1e-6
    net = Network(
        mean, scale,
        [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden),
         rng.normal(0, hidden**-0.5, hidden), np.zeros(1)],
        1.0,
    )
    xs, ys = (x[~held] - mean) / scale, y[~held]
    moment = [[np.zeros_like(p) for p in net.layers] for _ in range(2)]
    best, kept, t = np.inf, [p.copy() for p in net.layers], 0
    for turn in range(rounds):
        w1, b1, w2, b2 = net.layers
        for rows in np.array_split(rng.permutation(len(ys)), max(1, len(ys) // 512)):
            t += 1
            a = np.tanh(xs[rows] @ w1 + b1)
            pull = (1 / (1 + np.exp(-np.clip(a @ w2 + b2, -50, 50))) - ys[rows]) / len(rows)
            back = np.outer(pull, w2) * (1 - a * a)
            grads = (xs[rows].T @ back + 1e-4 * w1, back.sum(axis=0), a.T @ pull + 1e-4 * w2,
                     np.array([pull.sum()]))
            for p, g, m, v in zip(net.layers, grads, *moment, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p -= 0.005 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
        loss = _loss(net.logit(x[held]), y[held])
        if loss < best - 1e-5:
            best, kept, since = loss, [p.copy() for p in net.layers], turn
        elif turn - since >= 25:
            break
    net.layers = kept
    z = net.logit(x[held])
    net.temperature = min(np.geomspace(0.25, 8, 121), key=lambda k: _loss(z / k, y[held]))
    return net


def _loss(z: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, z) - y * z))


def _task_pool(held, extra: int):
    """(text, *extra) -> (pooled, *extra)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.slices(batches, "text"):
            x = pool(batch.column(0), held.value).astype(np.float32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r.tobytes() for r in x], pa.binary()), *batch.columns[1:]],
                names=["pooled", *batch.schema.names[1:]],
            )

    return run


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column,
    vectors: np.ndarray,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample: int = 12_000,
) -> Network:
    """Fit on at most ``sample`` labelled rows for whose id ``learn`` holds."""
    known = (
        labels.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & learn)
        .groupBy(F.col(id_col).alias("id"))
        .agg(F.avg(F.col(label_col).cast("double")).alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(sample)
    )
    # at most ``sample`` rows of two numbers
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(
        F.broadcast(known), "id"
    )
    held = docs.sparkSession.sparkContext.broadcast(vectors)
    kind = rows.schema["id"].dataType.simpleString()
    got = (
        rows.select("text", "id", "label")
        .mapInArrow(_task_pool(held, 2), f"pooled binary, id {kind}, label double")
        .orderBy(F.xxhash64("id"), "id", "pooled").limit(2 * sample)
        .toPandas()
    )
    x = np.array([np.frombuffer(p, np.float32) for p in got["pooled"]], np.float64)
    return fit(x.reshape(len(got), WIDTH), got["label"].to_numpy())


def _task_score(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, net = held.value
        for batch in words.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), pa.array(net.score(pool(batch.column(0), vectors)))],
                names=["id", "score"],
            )

    return run


def score(
    docs: DataFrame, vectors: np.ndarray, net: Network, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id and ``score`` (0 to 1)."""
    kind = docs.schema[id_col].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast((vectors, net))
    return (
        docs.select(F.col(text_col).alias("text"), F.col(id_col).alias("id"))
        .mapInArrow(_task_score(held), f"id {kind}, score double")
        .withColumnRenamed("id", id_col)
    )
