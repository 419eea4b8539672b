"""Language identification by error-correcting output codes.

Each language has a codeword of bits. One linear classifier per bit, on hashed
byte n-grams of the lower-cased text, predicts that bit; a text's language is the
one whose codeword costs least under the logistic losses of all bits, each bit
weighted by how well it does on held-back training rows. Texts whose best two
codewords are close are flagged as ambiguous.

The classifiers are fitted on the driver from about ``sample`` labelled texts in
all, shared equally by the languages and chosen by a hash of the id. This bound
is the only one: their features, like all scores, come from whole texts.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
null or repeated ids are scored like any other (a null id is never learnt from);
a null language is never learnt from; with no language to learn everything is
``und``, with one everything that has a letter is that; ties go to the first
language by code point; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm import words

UNKNOWN = "und"
DIMENSIONS = 1 << 13
_PLACES = 1 << 30
_ORDERS = (1, 2, 3)


def codebook(classes: int, seed: int = 7) -> np.ndarray:
    """One row of -1 and 1 per class, rows far apart, no column all one sign.

    Up to 7 classes: every way to split them in two. Beyond: the best of some
    random draws of 15 bits per doubling of the classes.
    """
    if classes < 2:
        return np.ones((classes, 1), dtype=np.int8)
    if classes <= 7:
        splits = [[(s >> c) & 1 for c in range(classes)] for s in range(1, 2 ** (classes - 1))]
        return (2 * np.array(splits).T - 1).astype(np.int8)
    width = int(np.ceil(15 * np.log2(classes)))
    rng = np.random.default_rng(seed)
    best, widest = None, -1
    for _ in range(50):
        code = 2 * rng.integers(0, 2, (classes, width)) - 1
        one = np.abs(code.sum(axis=0)) == classes
        code[0, one] *= -1
        apart = width - (code @ code.T + width) // 2
        gap = int((apart + width * np.eye(classes, dtype=int)).min())
        if gap > widest:
            best, widest = code.astype(np.int8), gap
    return best


def _grams(a: np.ndarray) -> Iterator[np.ndarray]:
    """Hashed positions of all byte n-grams, one array per order."""
    h = np.zeros(len(a), dtype=np.uint64)
    x = a.astype(np.uint64) + np.uint64(1)
    for n in _ORDERS:
        if len(a) < n:
            return
        h = h[: len(a) - n + 1] * np.uint64(0x100000001B3) + x[n - 1 :]
        yield (words.mixed(h + np.uint64(n)) >> np.uint64(51)).astype(np.int32)


_PIECE = 1 << 20


def gram_counts(raw: bytes) -> np.ndarray:
    """How often each hashed n-gram occurs in a text, taken up in pieces."""
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    for at in range(0, len(raw), _PIECE):
        piece = np.frombuffer(raw[at : at + _PIECE + max(_ORDERS) - 1], dtype=np.uint8)
        for h in _grams(piece):
            counts += np.bincount(h[:_PIECE], minlength=DIMENSIONS)
    return counts


def features(counts: np.ndarray) -> np.ndarray:
    """Square roots of counts at unit length."""
    root = np.sqrt(counts, dtype=np.float32)
    norm = np.sqrt(np.einsum("...i,...i->...", root, root))[..., None]
    root /= np.where(norm > 0, norm, 1)
    return root


def lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    code: np.ndarray  # classes x bits
    weights: np.ndarray  # dimensions x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def costs(self, x: np.ndarray) -> np.ndarray:
        """Rows x classes: the weighted logistic loss of each codeword."""
        margin = x @ self.weights + self.bias
        loss = lambda m: np.logaddexp(0.0, -m)
        up, down = loss(margin) * self.trust, loss(-margin) * self.trust
        return up @ (self.code.T > 0) + down @ (self.code.T < 0)

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best class, its score from 0 to 1, and the lead over the second."""
        cost = self.costs(x)
        p = np.exp(cost.min(axis=1, keepdims=True) - cost)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        ranked = np.sort(p, axis=1)
        lead = ranked[:, -1] - ranked[:, -2] if p.shape[1] > 1 else ranked[:, -1]
        return best, p[np.arange(len(p)), best], lead


def fit(x: np.ndarray, languages: Sequence[str], rounds: int = 60, seed: int = 5) -> Model:
    """Logistic classifiers for all bits at once, by full-batch Adam.

    A fifth of the rows is held back to see how far each bit can be trusted.
    """
    names = tuple(sorted(set(languages)))
    code = codebook(len(names))
    bits = code.shape[1]
    if len(names) < 2:
        flat = np.zeros((DIMENSIONS, bits), np.float32)
        return Model(names, code, flat, np.zeros(bits, np.float32), np.ones(bits))
    y = code[[names.index(v) for v in languages]].astype(np.float32)
    held = np.random.default_rng(seed).random(len(x)) < 0.2
    if held.all() or not held.any():
        held = np.arange(len(x)) % 5 == 0
    learn = ~held if (~held).any() else held
    w, b = np.zeros((DIMENSIONS, bits), np.float32), np.zeros(bits, np.float32)
    m = [np.zeros_like(w), np.zeros_like(b)]
    v = [np.zeros_like(w), np.zeros_like(b)]
    xs, ys = x[learn], y[learn]
    for t in range(1, rounds + 1):
        pull = -ys / (1 + np.exp(np.clip(ys * (xs @ w + b), -30, 30))) / len(xs)
        for i, (p, g) in enumerate(((w, xs.T @ pull + 1e-6 * w), (b, pull.sum(axis=0)))):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            p -= 0.3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.99**t)) + 1e-8)
    right = (np.sign(x[held] @ w + b) == y[held]).mean(axis=0)
    right = np.clip(right, 0.501, 0.999)
    trust = np.log(right / (1 - right))
    return Model(names, code, w, b, trust / trust.mean())


def _task_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) -> (lang, the n-grams that occur, how often)."""
    for batch in words.slices(batches, "text"):
        at, times = [], []
        for text in batch.column(1).to_pylist():
            counts = gram_counts(lowered(text))
            some = np.flatnonzero(counts)
            at.append(some.astype(np.uint16).tobytes())
            times.append(counts[some].astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(at, pa.binary()), pa.array(times, pa.binary())],
            names=["lang", "at", "times"],
        )


def train(
    docs: DataFrame,
    learn: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample: int = 2000,
) -> Model:
    """Fit on about ``sample`` of the rows for which ``learn`` holds."""
    known = docs.filter(learn).filter(
        F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()
    )
    # one number per language, as many as the model has codewords
    sizes = dict(known.groupBy(lang_col).count().collect())
    if not sizes:
        return fit(np.zeros((0, DIMENSIONS), np.float32), [])
    each = max(20, sample // len(sizes))
    share = F.create_map(
        *[F.lit(v) for name, n in sorted(sizes.items()) for v in (name, int(_PLACES * min(1.0, each / n)))]
    )
    place = F.pmod(F.xxhash64(F.col(id_col)), F.lit(_PLACES))
    drawn = known.filter(place < share[F.col(lang_col)]).select(
        F.col(lang_col).alias("lang"), F.col(text_col).alias("text")
    ).filter(F.col("text").rlike(r"\p{L}"))
    got = drawn.mapInArrow(_task_counts, "lang string, at binary, times binary").toPandas()
    x = np.zeros((len(got), DIMENSIONS), np.float32)
    for i, (at, times) in enumerate(zip(got["at"], got["times"], strict=True)):
        x[i, np.frombuffer(at, np.uint16)] = np.frombuffer(times, np.float32)
    return fit(features(x), list(got["lang"]))


def _task_predict(held, margin: float):
    """(text, letter, *kept) -> (*kept, language, score, unsure)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        for batch in words.slices(batches, "text"):
            n = batch.num_rows
            names, scores, unsure = [UNKNOWN] * n, np.zeros(n), np.ones(n, dtype=bool)
            letter = batch.column(1).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(letter) if model.languages else np.zeros(0, int)
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                x = np.empty((len(part), DIMENSIONS), np.float32)  # one table, not one of each count and its copy
                for row, i in zip(x, part, strict=True):
                    row[:] = gram_counts(lowered(batch.column(0)[i].as_py()))
                x = features(x)
                best, score, lead = model.predict(x)
                for i, b in zip(part, best, strict=True):
                    names[i] = model.languages[b]
                scores[part], unsure[part] = score, lead < margin
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(names), pa.array(scores), pa.array(unsure)],
                names=[*batch.schema.names[2:], "language", "score", "unsure"],
            )

    return run


def identify(
    docs: DataFrame,
    model: Model,
    keep: Sequence[str] = ("doc_id",),
    text_col: str = "text",
    margin: float = 0.2,
    names: Sequence[str] = ("lang_pred", "score", "ambiguous"),
) -> DataFrame:
    """One row per row of ``docs``: the columns to keep, language, score, and whether
    the best two are less than ``margin`` apart; the last three by ``names``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = docs.sparkSession.sparkContext.broadcast(model)
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    plain = docs.select(text.alias("text"), text.rlike(r"\p{L}").alias("letter"), *kept)
    schema = T.StructType(
        [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
        + [T.StructField("language", T.StringType()), T.StructField("score", T.DoubleType()),
           T.StructField("unsure", T.BooleanType())]
    )
    return plain.mapInArrow(_task_predict(held, margin), schema).toDF(*keep, *names)
