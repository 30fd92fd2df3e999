"""Quality classifier: naive Bayes support vectors.

Features are hashed indicators of n-grams: words and word pairs in lower case,
and runs of up to three word shapes (letters, digits and marks of a token, "="
for a token that repeats its predecessor). Each indicator is scaled by the
log-ratio of its smoothed frequency in the two classes; a linear model with
hinge loss is fitted on them by dual coordinate descent and interpolated with
its mean magnitude, (1 - b) mean|w| + b w with b = 0.25, as in the published
method. Held-in cross-fitting gives decision
values for a logistic calibration, so a score is a probability.

The model is fitted on at most ``max_rows`` labelled documents, those whose
hashed id is least, in one task; scoring reads every whole text where it lies.

Cases: labels other than 0 and 1 and labels without a document are ignored;
of several labels of a document the largest counts, of several rows with one
id one is learned from. Very long texts are read whole; a worker holds one text's
terms at a time. Null and empty texts have no n-gram and get the
intercept's score. Where fewer than two classes are known every score is the
class's share (0.5 without labels). Ties and repeated rows get equal scores.
An empty table gives no rows. Columns other than id and text are ignored by
``fit`` and kept by ``score``, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import TermCache, crc_bucket, fresh, mix64, text_or_empty

BITS = 18
MAX_ROWS = 12_000
THRESHOLD = 0.3
#: Published: how much a weight keeps of its own beside the mean magnitude.
INTERPOLATION = 0.25

_RUNS = re.compile(r"[^\W\d_]+|\d+|(\W)\1*|_+")


def _shape(token: str) -> str:
    def kind(m):
        x = m.group()
        if x[0].isalpha():
            return "A" if len(x) > 1 and x.isupper() else "a"
        return "0" if x[0].isdigit() else x[:2]

    return _RUNS.sub(kind, token)[:24]


def _term(token: str) -> int:
    low = token.lower().encode("utf-8", "surrogatepass")
    return zlib.crc32(low) << 32 | zlib.crc32(_shape(token).encode("utf-8", "surrogatepass"), 7)


_cache = TermCache(_term)
_HIGH, _LOW, _SHIFT = np.uint64(32), np.uint64(0xFFFFFFFF), np.uint64(64 - BITS)


def features(text: str) -> np.ndarray:
    """Sorted distinct feature numbers of a text."""
    tokens = text.split()
    if not tokens:
        return np.empty(0, np.int32)
    both = _cache.array(tokens)
    word, shape = both >> _HIGH, both & _LOW
    shape[1:][word[1:] == word[:-1]] = 1
    k1, k2, k3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
    parts = [word * k1, word[:-1] * k2 + word[1:] * k3 + np.uint64(1), shape * k2 + np.uint64(2), shape[:-1] * k1 + shape[1:] * k2 + np.uint64(3), shape[:-2] * k1 + shape[1:-1] * k2 + shape[2:] * k3 + np.uint64(4)]
    return np.unique((mix64(np.concatenate(parts)) >> _SHIFT).astype(np.int32))


@dataclass
class Model:
    weights: np.ndarray  # weight times log-ratio, by feature number
    bias: float
    slope: float
    offset: float

    def decide(self, f: np.ndarray) -> float:
        return float(self.weights[f].sum() / max(1.0, len(f)) ** 0.5 + self.bias)

    def score(self, f: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.decide(f) + self.offset, -30, 30))))


def log_ratios(rows: list[np.ndarray], y: np.ndarray, least: int = 3) -> np.ndarray:
    """log of the classes' smoothed indicator frequencies; 0 for features seen
    in fewer than ``least`` documents."""
    count = [np.bincount(np.concatenate([np.empty(0, np.int32), *(r for r, s in zip(rows, y) if s == side)]), minlength=1 << BITS) for side in (1, -1)]
    n = [max(1, int((y == side).sum())) for side in (1, -1)]
    ratio = np.log((count[0] + 1) / (n[0] + 2)) - np.log((count[1] + 1) / (n[1] + 2))
    return np.where(count[0] + count[1] >= least, ratio, 0.0)


def hinge_weights(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, c: float = 1.0, epochs: int = 12, seed: int = 0, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights of the scaled indicators and bias of the hinge-loss model; both
    classes weigh the same."""
    x = [ratio[r] / max(1.0, len(r)) ** 0.5 for r in rows]
    diagonal = np.array([v @ v + 1.0 for v in x])
    side = {s: c * len(y) / (2 * max(1, int((y == s).sum()))) for s in (1, -1)}
    w, b, alpha, rng = np.zeros(1 << BITS), 0.0, np.zeros(len(y)), np.random.default_rng(seed)
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(len(y)):
            gradient = y[i] * (w[rows[i]] @ x[i] + b) - 1
            new = min(max(alpha[i] - gradient / diagonal[i], 0.0), side[y[i]])
            if step := (new - alpha[i]) * y[i]:
                w[rows[i]] += step * x[i]
                b += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < tolerance:
            break
    return w, b


def dual_descent(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray) -> tuple[np.ndarray, float]:
    """Interpolated weights (scaled back to indicators) and bias."""
    w, b = hinge_weights(rows, y, ratio)
    used = np.flatnonzero(w)
    mean = np.abs(w[used]).mean() if len(used) else 0.0
    mixed = INTERPOLATION * w + (1 - INTERPOLATION) * mean * (w != 0)
    return mixed * ratio, b


def calibrate(d: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve through decision values (Newton)."""
    target = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -30, 30)))
        g, v = np.array([((p - target) * d).sum() + 1e-3 * a, (p - target).sum()]), p * (1 - p) + 1e-9
        h = np.array([[(v * d * d).sum() + 1e-3, (v * d).sum()], [(v * d).sum(), v.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fit_rows(rows: list[np.ndarray], y: np.ndarray) -> Model:
    """y: +1 and -1."""
    if len(set(y.tolist())) < 2:
        share = (float((y > 0).mean()) * len(y) + 0.5) / (len(y) + 1) if len(y) else 0.5
        return Model(np.zeros(1 << BITS, np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    decided = np.zeros(len(y))
    for fold in (0, 1):
        inside, out = [np.flatnonzero(np.arange(len(y)) % 2 == side) for side in (1 - fold, fold)]
        ratio = log_ratios([rows[i] for i in inside], y[inside])
        w, b = dual_descent([rows[i] for i in inside], y[inside], ratio)
        decided[out] = [w[rows[i]].sum() / max(1.0, len(rows[i])) ** 0.5 + b for i in out]
    slope, offset = calibrate(decided, y)
    w, b = dual_descent(rows, y, log_ratios(rows, y))
    return Model(w.astype(np.float32), b, slope, offset)


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fits on labelled documents outside the held-out fold, ``max_rows`` at most."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (crc_bucket() != 0))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)

    def featured(batches):
        for b in batches:
            rows = [features(t.as_py()) for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "quality", "f"])

    def fitted(batches):
        ids, ys, rows = [], [], []
        for b in batches:
            ids += b.column("doc_id").to_pylist()
            ys += b.column("quality").to_pylist()
            rows += [x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, np.int32) for x in b.column("f")]
        order = np.argsort(np.array(ids, np.int64), kind="stable")
        m = fit_rows([rows[i] for i in order], np.array([1 if ys[i] else -1 for i in order]))
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.tobytes()]), pa.array([[m.bias, m.slope, m.offset]])], ["w", "p"])

    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    sample = texts.join(F.broadcast(chosen.select(F.col("doc_id").cast("long"), F.col("quality").cast("int"))), "doc_id")  # max_rows ids
    rows = sample.mapInArrow(featured, "doc_id long, quality int, f array<int>").dropDuplicates(["doc_id"])
    w, p = rows.repartition(1).mapInArrow(fitted, "w binary, p array<double>").first()  # one model
    return Model(np.frombuffer(bytes(w), np.float32), *p)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """All columns of ``docs`` plus the score as ``name`` (instead of a column of
    that name)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2^18 weights
    out = docs.drop(name)
    (text,) = fresh(docs, "whole_text")

    def run(batches):
        for b in batches:
            s = [shared.value.score(features(t.as_py() or "")) for t in b.column(text)]
            keep = b.select([n for n in b.schema.names if n != text])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(s, pa.float64())], names=[*keep.schema.names, name])

    schema = StructType([StructField(f.name, f.dataType) for f in out.schema.fields] + [StructField(name, DoubleType())])
    return out.withColumn(text, text_or_empty()).mapInArrow(run, schema)
