"""Quality classifier by positive-unlabelled learning with the non-negative unbiased risk.

Trusted positives P (labelled 1) and unlabelled web text U give, with the class prior p,

    risk = p * E_P[l(+g)] + max(0, E_U[l(-g)] - p * E_P[l(-g)])

with the logistic loss l. Where a batch drives the second term below zero the step ascends it instead, so
the model can't gain by calling positives in U negative. The model is a small network over the shape of a
text (kinds of characters and of their neighbours, repeated words and lines, lengths) of its whole length.
It is trained in numpy on the driver on a bounded sample: `MAX_POSITIVES` and `MAX_UNLABELLED` rows, drawn
by a hash of the id. Scoring runs in tasks.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terracast.llm import words as wd

MAX_POSITIVES = 16_000
MAX_UNLABELLED = 32_000
THRESHOLD = 0.3
HIDDEN = 24
STEPS = 1_500

LINES = np.ones(256, dtype=bool)
LINES[10] = False
KINDS = 13
KIND = np.full(256, 8, dtype=np.int64)  # other symbols
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 0, 1, 2, 9
KIND[:32] = 10
KIND[[32, 10]] = 3, 4
KIND[[46, 44]] = 5, 6
for _c in b";:'\"-()":
    KIND[_c] = 7
for _c in b"!?":
    KIND[_c] = 11
for _c in b"|/\\<>{}[]":
    KIND[_c] = 12
N_FEATURES = KINDS * KINDS + KINDS + 11


def _repeats(row: np.ndarray, value: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text: number of values, of distinct values, and of the most frequent one."""
    n = np.bincount(row, minlength=rows)
    if not len(row):
        return n, n, n
    order = np.lexsort((value, row))
    r, v = row[order], value[order]
    new = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (v[1:] != v[:-1])]))
    size = np.diff(np.concatenate([new, [len(r)]]))
    most = np.zeros(rows, dtype=np.int64)
    np.maximum.at(most, r[new], size)
    return n, np.bincount(r[new], minlength=rows), most


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(texts, N_FEATURES) shape of each text; an empty text is all zero but for its lengths."""
    rows = len(at) - 1
    size = np.diff(at)
    row = np.repeat(np.arange(rows), size)
    kind = KIND[data]
    one = np.bincount(row * KINDS + kind, minlength=rows * KINDS).reshape(rows, KINDS)
    same = row[1:] == row[:-1]
    pair = (row[1:] * KINDS + kind[1:]) * KINDS + kind[:-1]
    two = np.bincount(pair[same], minlength=rows * KINDS * KINDS).reshape(rows, KINDS * KINDS)
    w = wd.split(data, at, wd.SPACED)
    h = w.hashes()
    n, distinct, most = _repeats(w.row, h, rows)
    again = np.bincount(w.row[1:][(h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])], minlength=rows)
    length = (w.end - w.start).astype(np.float64)
    total, square = np.bincount(w.row, length, minlength=rows), np.bincount(w.row, length**2, minlength=rows)
    short = np.bincount(w.row, length <= 3, minlength=rows)
    lines = wd.split(data, at, LINES, lower=False)
    ln, ldistinct, lmost = _repeats(lines.row, lines.hashes(), rows)
    div = lambda a, b: a / np.maximum(b, 1)
    mean = div(total, n)
    spread = np.sqrt(np.maximum(div(square, n) - mean**2, 0))
    shares = np.column_stack([div(one, size[:, None]), div(two, size[:, None] - 1), div(distinct, n), div(most, n), div(again, n), div(short, n), div(ldistinct, ln), div(lmost, ln)])
    rest = np.column_stack([np.log1p(mean), np.log1p(spread), np.log1p(n), np.log1p(ln), np.log1p(div(size, ln))])
    return np.hstack([np.sqrt(shares), rest]).astype(np.float32)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: list
    prior: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        w1, b1, w2, b2, skip = self.weights
        return np.tanh(z @ w1 + b1) @ w2 + z @ skip + b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x).astype(np.float64), -50, 50)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, seed: int = 11) -> Model:
    """Minimise the non-negative risk with Adam on batches of both samples."""
    rng = np.random.default_rng(seed)
    d = unlabelled.shape[1]
    mean, scale = unlabelled.mean(0), np.maximum(unlabelled.std(0), 0.02)
    weights = [rng.normal(0, 0.5 / np.sqrt(d), (d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), np.zeros(1), np.zeros(d)]
    weights = [w.astype(np.float32) for w in weights]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    zp, zu = (np.clip((x - mean) / scale, -6, 6).astype(np.float32) for x in (positive, unlabelled))
    sig = lambda g: 1 / (1 + np.exp(-np.clip(g, -30, 30)))
    for step in range(1, steps + 1):
        xp, xu = zp[rng.integers(0, len(zp), min(1024, len(zp)))], zu[rng.integers(0, len(zu), min(2048, len(zu)))]
        x = np.vstack([xp, xu])
        w1, b1, w2, b2, skip = weights
        hidden = np.tanh(x @ w1 + b1)
        g = hidden @ w2 + x @ skip + b2
        gp, gu = g[: len(xp)], g[len(xp):]
        negative = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        minus_p, minus_u = -prior * sig(gp) / len(gp), sig(gu) / len(gu)
        slope = np.concatenate([-prior * sig(-gp) / len(gp) + minus_p, minus_u]) if negative >= 0 else -np.concatenate([minus_p, minus_u])
        slope = slope.astype(np.float32)
        back = np.outer(slope, w2) * (1 - hidden**2)
        grads = [x.T @ back, back.sum(0), hidden.T @ slope, slope.sum(keepdims=True), x.T @ slope]
        rate = 0.01 * (0.1 + 0.9 * (1 - step / steps))
        for k, (w, gr) in enumerate(zip(weights, grads, strict=True)):
            gr = gr + (1e-4 * w if w.ndim > 1 or k == 4 else 0)
            first[k] = 0.9 * first[k] + 0.1 * gr
            second[k] = 0.999 * second[k] + 0.001 * gr**2
            weights[k] = (w - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, weights, prior)


def held_out(id_col: str = "doc_id"):
    """Rows whose crc32(id as text) is divisible by 5; a null id is none of them."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _collect(texts: DataFrame) -> np.ndarray:
    """Features of a bounded sample of texts."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, data, at in wd.runs(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([features(data, at).tobytes()], pa.binary())], names=["x"])

    rows = texts.mapInArrow(make, "x binary").toArrow().column("x")
    return np.concatenate([np.zeros((0, N_FEATURES), np.float32), *(np.frombuffer(x.as_py(), np.float32).reshape(-1, N_FEATURES) for x in rows)])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_positives: int = MAX_POSITIVES, max_unlabelled: int = MAX_UNLABELLED) -> Model | None:
    """Fit on rows that aren't held out; None without a labelled positive text.

    An id with several labels counts as positive if one of them is 1. The prior is the share of 1 among the
    labelled training ids, kept within 0.02 and 0.98.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y"))
    n, positives = known.agg(F.count(F.lit(1)), F.coalesce(F.sum((F.col("y") == 1).cast("long")), F.lit(0))).first()
    total = docs.count()
    if not positives or not total:
        return None
    share = lambda salt, most, of: F.pmod(F.xxhash64(F.lit(salt), "id"), F.lit(1 << 20)) < int(min(1.0, most / of) * (1 << 20))
    # about max_positives ids: a bounded table
    chosen = known.where((F.col("y") == 1) & share(1, max_positives, positives)).select("id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    positive = _collect(texts.join(F.broadcast(chosen), "id", "left_semi").select("text"))
    unlabelled = _collect(texts.where(~held_out("id") & share(2, max_unlabelled, total)).select("text"))
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, float(np.clip(positives / n, 0.02, 0.98)))


def scored(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", name: str = "score") -> DataFrame:
    """docs with a column of scores from 0 to 1 (0.5 without a model); a null text counts as empty. A column of that name is replaced."""
    docs = docs.drop(name)
    names = [*docs.columns, name]
    at = names.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, data, offsets in wd.runs(b.column(at)):
                score = model.score(features(data, offsets)) if model else np.full(end - first, 0.5)
                yield pa.RecordBatch.from_arrays([*b.slice(first, end - first).columns, pa.array(score, pa.float64())], names=names)

    return docs.mapInArrow(rate, f"{schema}, `{name}` double")
