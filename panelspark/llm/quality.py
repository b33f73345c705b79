"""Quality classifier: Naive Bayes support vectors.

Features are indicators of n-grams, hashed to 2**18: runs of 1 to 3 bytes, and runs of 1 to 3 word shapes.  A shape
says how a word is cased, what it ends in, whether signs stand inside it and whether it repeats the word before.
Each indicator is scaled by its class log-count ratio r = log((p / |p|) / (q / |q|)); a linear hinge-loss model on the
scaled indicators is fitted by dual coordinate descent, drawn towards its mean weight (beta), and its margins are
turned into probabilities by a logistic fit.

Fitting uses a bounded sample of the labelled rows (``sample``), drawn by a hash of doc_id and read to the driver as
feature ids.  Scoring is one narrow pass over whole texts with a 1 MB weight vector.

Null, empty or blank text has no shapes: it gets the model's score for no features.  Without labels of both classes
the score is the smoothed share of label 1, one half without any.  Repeated rows are scored each.  Of a document
labelled several times the lowest label counts.  Columns other than the id and the text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean, need, texts_of
from .textscan import mix, slices, windows, words

FEATURES = 1 << 18
#: Labelled rows that the model is fitted to, at most.
SAMPLE = 6_000
#: Bytes of text whose features are made at once: each byte takes some 200 while they are.
SLICE = 1 << 18

_MASK = np.uint64(FEATURES - 1)
_KIND = np.full(256, 3, np.uint8)
_KIND[[*range(97, 123), *range(128, 256)]] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2


def _per_text(owner: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(owner, np.arange(n + 1))


def _shapes(data: np.ndarray, w) -> np.ndarray:
    """A small number for each word: case, last byte, inner signs, repetition."""
    kind = _KIND[data]
    sums = np.concatenate([np.zeros((4, 1), np.int64), np.cumsum(kind == np.arange(4)[:, None], axis=1)], axis=1)
    lower, upper, digit, sign = (s[w.end] - s[w.start] for s in sums)
    last = data[w.end - 1]
    trailing = np.where(_KIND[last] == 3, last, 0).astype(np.int64)
    inner = sign - (_KIND[last] == 3) > 0
    case = np.where(digit > 0, 4, np.where(upper == 0, np.where(lower == 0, 0, 1), np.where(lower > 0, 2, 3)))
    again = np.zeros(len(w.hash), bool)
    again[1:] = w.hash[1:] == w.hash[:-1]
    start = w.first[:-1][np.diff(w.first) > 0]
    again[start] = False
    return ((trailing * 5 + case) * 2 + inner) * 2 + again


def features(data: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    """Distinct feature ids of each text, unsorted."""
    n = len(offs) - 1
    w = words(data, offs)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    sizes, counts = np.diff(offs), np.diff(w.first)
    grams = data.astype(np.uint64) + np.uint64(1)
    run = np.zeros(len(data), np.uint64)
    left = np.repeat(offs[1:], sizes) - np.arange(len(data))
    for k in (1, 2, 3):
        run[: len(data) - k + 1] |= grams[k - 1 :] << np.uint64(9 * (k - 1))
        at = np.flatnonzero(left >= k)
        found.append((at, mix(run[at] + np.uint64(k << 40)) & _MASK))
    owner_bytes = np.repeat(np.arange(n), sizes)
    if len(w.hash):
        shape = mix(_shapes(data, w).astype(np.uint64) + np.uint64(7 << 40))
        room = np.repeat(w.first[1:], counts) - np.arange(len(shape))
        owner_words = np.repeat(np.arange(n), counts)
    cuts = [_per_text(owner_bytes[at], n) for at, _ in found]
    parts = [[ids[c[i] : c[i + 1]] for (_, ids), c in zip(found, cuts, strict=True)] for i in range(n)]
    if len(w.hash):
        for k in (1, 2, 3):
            some = windows(shape, k) & _MASK
            at = np.flatnonzero(room[: len(some)] >= k)
            cut = _per_text(owner_words[at], n)
            for i in range(n):
                parts[i].append(some[at[cut[i] : cut[i + 1]]])
    stamp = np.empty(FEATURES, np.int64)
    out = []
    for each in parts:
        ids = np.concatenate(each).astype(np.int64)
        place = np.arange(len(ids))
        stamp[ids] = place
        out.append(ids[stamp[ids] == place])
    return out


@dataclass(frozen=True)
class QualityModel:
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, ids: np.ndarray) -> float:
        return float(self.weights[np.sort(ids)].sum() + self.bias)

    def score(self, ids: np.ndarray) -> float:
        z = np.clip(self.slope * self.margin(ids) + self.shift, -500, 500)
        return float(1 / (1 + np.exp(-z)))


def _descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int, tolerance: float) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the L1 hinge loss; the bias is one more feature."""
    w, bias = np.zeros(FEATURES), 0.0
    values = [ratio[r] for r in rows]
    norms = np.array([v @ v + 1 for v in values])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)).tolist():
            r, v = rows[i], values[i]
            gradient = y[i] * (w[r] @ v + bias) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                alpha[i] = new
                w[r] += step * y[i] * v
                bias += step * y[i]
                worst = max(worst, abs(step) * norms[i])
        if worst < tolerance:
            break
    return w, bias


def _logistic(margin: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit with smoothed targets, by Newton steps."""
    n1, n0 = label.sum(), len(label) - label.sum()
    target = np.where(label == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    theta = np.array([1.0, np.log((n1 + 1) / (n0 + 1))])

    def loss(t):
        z = np.clip(x @ t, -500, 500)
        return float(np.sum(np.logaddexp(0, z) - target * z)) + 1e-6 * float(t @ t)

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -500, 500)))
        gradient = x.T @ (p - target) + 2e-6 * theta
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 2e-6 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        size = 1.0
        while loss(theta - size * step) > loss(theta) and size > 1e-6:
            size /= 2
        theta = theta - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(max(theta[0], 1e-6)), float(theta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, beta: float = 0.25, epochs: int = 30, tolerance: float = 1e-2) -> QualityModel:
    """A model of 0/1 ``labels`` for rows of distinct feature ids."""
    labels = np.asarray(labels)
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    if not n0 or not n1:
        share = (n1 + 1) / (len(labels) + 2)
        return QualityModel(np.zeros(FEATURES), 0.0, 1.0, float(np.log(share / (1 - share))))
    p, q = np.ones(FEATURES), np.ones(FEATURES)
    for r, label in zip(rows, labels, strict=True):
        (p if label else q)[r] += 1
    ratio = np.log((p / p.sum()) / (q / q.sum()))
    y = np.where(labels == 1, 1.0, -1.0)
    costs = np.where(labels == 1, cost * len(labels) / (2 * n1), cost * len(labels) / (2 * n0))
    w, bias = _descend(rows, y, ratio, costs, epochs, tolerance)
    w = (1 - beta) * np.abs(w).mean() * np.sign(w) * (w != 0) + beta * w
    weights = w * ratio
    half = QualityModel(weights, bias, 1.0, 0.0)
    return QualityModel(weights, bias, *_logistic(np.array([half.margin(r) for r in rows]), labels))


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows, data, offs in slices(batch, "text", SLICE):
            found = [f.astype(np.int32) for f in features(data, offs)]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found)))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("quality"), ids], ["doc_id", "quality", "ids"])


def fit_quality(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Fits to at most ``sample`` of the rows of ``labels`` (id, 0/1) that have a text."""
    need(labels, id_col, label_col)
    marks = labels.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("quality"))
    marks = marks.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = marks.count()
    if n > sample:
        # the same rows however they are dealt
        marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # a broadcast of at most ``sample`` rows
    some = texts_of(df, id_col, text_col).join(F.broadcast(marks), "doc_id")
    rows = some.mapInArrow(lean(_featurise), "doc_id long, quality int, ids array<int>").toArrow().sort_by("doc_id")
    ids = [np.asarray(r.values) for r in rows.column("ids")]
    return fit([np.sort(i) for i in ids], rows.column("quality").to_numpy())


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = model.value
        for batch in batches:
            for rows, data, offs in slices(batch, "text", SLICE):
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array([use.score(f) for f in features(data, offs)], pa.float64())], ["doc_id", "score"])

    return run


def score_quality(df: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    return texts_of(df, id_col, text_col).mapInArrow(lean(_score(shared)), "doc_id long, score double")


def with_quality(df: DataFrame, model: QualityModel, column: str = "quality_score", text_col: str = "text") -> DataFrame:
    """``df`` with the score in ``column`` (which replaces one of that name)."""
    need(df, text_col)
    bound_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    rest = df.select(*[F.col(f"`{c}`") for c in df.columns if c != column], F.col(f"`{text_col}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(f) for _, data, offs in slices(batch, "__text", SLICE) for f in features(data, offs)]
            names = batch.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], [*names, column])

    schema = type(rest.schema)(rest.schema.fields[:-1]).add(column, "double")
    return rest.mapInArrow(lean(run), schema)
