"""Quality classifier: Bradley-Terry ranking from preference pairs, cut at a score quantile.

Each document has a vector of features of its whole text: shares of its words
and of its byte 4-grams in hashed buckets, and a few counts.  A preference pair
is a document labelled 1 over one labelled 0; the model learns weights w by
logistic loss on feature differences, P(a over b) = sigmoid(w.(f(a) - f(b))).
The learned strength w.f ranks documents; the cut is the quantile of the
strengths of the learning sample that separates its labels best, and the score
is the sigmoid of the distance to the cut, so 0.5 lies on the cut.

Fitting uses a bounded sample: ``sample`` labelled rows (both labels alike, by
a hash of their id) and ``pairs`` preference pairs drawn from them by a seed.
Scoring reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, NON_SPACE, U64, Words, chunks, lean, mix

SAMPLE = 8000
PAIRS = 400_000
SEED = 11
#: Buckets of words and of byte 4-grams, powers of two.
WORD_BUCKETS = 1024
GRAM_BUCKETS = 1024
PIECE = 1 << 18

_UPPER, _DIGIT, _OTHER = (np.zeros(256, bool) for _ in range(3))
_UPPER[0x41:0x5B] = True
_DIGIT[0x30:0x3A] = True
_OTHER[[k for k in range(0x21, 0x7F) if not chr(k).isalnum()]] = True
COUNTS = 10
WIDTH = WORD_BUCKETS + GRAM_BUCKETS + COUNTS


def _totals(flag: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How often flag holds in each row."""
    total = np.concatenate([[0], np.cumsum(flag)])
    return total[offs[1:]] - total[offs[:-1]]


def _shares(row: np.ndarray, bucket: np.ndarray, rows: int, buckets: int) -> np.ndarray:
    """Square roots of each bucket's share of a row, so that rows have length one (zero where there is nothing)."""
    n = np.bincount(row * buckets + bucket, minlength=rows * buckets).reshape(rows, buckets).astype(np.float32)
    return np.sqrt(n / np.maximum(n.sum(1, keepdims=True), 1))


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """rows x WIDTH for the texts data[offs[i]:offs[i + 1]]; all finite, for empty texts too."""
    n, rows = len(data), len(offs) - 1
    lower = LOWER[data]
    w = Words(lower, offs, NON_SPACE)
    h = w.hashes(lower)
    words = _shares(w.row, (h >> U64(64 - WORD_BUCKETS.bit_length() + 1)).astype(np.int64), rows, WORD_BUCKETS)
    size = np.diff(offs)
    starts = np.maximum(size - 3, 0)
    row = np.repeat(np.arange(rows), starts)
    at = np.arange(len(row)) - np.repeat(np.cumsum(starts) - starts, starts) + np.repeat(offs[:-1], starts)
    gram = np.zeros(max(n - 3, 0), np.uint32)
    for k in range(4):
        gram |= data[k : k + len(gram)].astype(np.uint32) << np.uint32(8 * k)
    bucket = mix(gram[at].astype(U64)) >> U64(64 - GRAM_BUCKETS.bit_length() + 1)
    grams = _shares(row, bucket.astype(np.int64), rows, GRAM_BUCKETS)
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (w.row[1:] == w.row[:-1])
    marks = _OTHER[data]
    twice = np.zeros(n, bool)
    twice[1:] = marks[1:] & (data[1:] == data[:-1])
    twice[offs[:-1][offs[:-1] < n]] = False  # a text's first byte follows nothing
    key = w.row[np.unique(h ^ mix(w.row.astype(U64)), return_index=True)[1]]
    chars, tokens = np.maximum(size, 1), np.maximum(w.count, 1)
    counts = np.stack([
        _totals(_UPPER[data], offs) / chars, _totals(_DIGIT[data], offs) / chars, _totals(marks, offs) / chars, _totals(twice, offs) / chars,
        _totals(data == 10, offs) / chars, _totals(again, w.first) / tokens, np.bincount(key, minlength=rows) / tokens,
        np.log1p(size) / 10, np.log1p(w.count) / 10, (w.count == 0).astype(float),
    ], axis=1)
    return np.concatenate([words, grams, counts.astype(np.float32)], axis=1)


@dataclass
class BradleyTerry:
    weight: np.ndarray
    cut: float
    spread: float
    quantile: float

    def score(self, x: np.ndarray) -> np.ndarray:
        # row by row in one order, so that a score does not hang on the rows beside it
        z = (np.einsum("ij,j->i", x.astype(float), self.weight) - self.cut) / self.spread
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_pairs(x: np.ndarray, label: np.ndarray, pairs: int = PAIRS, seed: int = SEED, batch: int = 256, ridge: float = 1e-4) -> BradleyTerry:
    """Learn from rows x with labels 0 and 1; with only one label, or no row, every score is that label's side."""
    d = x.shape[1] if x.ndim == 2 else WIDTH
    if not len(x) or label.min() == label.max():
        only = float(label[0]) if len(x) else 1.0
        return BradleyTerry(np.zeros(d), -1.0 if only else 1.0, 1.0, 1.0 - only)
    rng = np.random.default_rng(seed)
    good, bad = np.flatnonzero(label == 1), np.flatnonzero(label == 0)
    w, velocity, square = np.zeros(d), np.zeros(d), np.zeros(d)
    for t in range(1, max(1, pairs // batch) + 1):  # Adam, a batch of pairs a step
        diff = x[rng.choice(good, batch)].astype(float) - x[rng.choice(bad, batch)]
        p = 1 / (1 + np.exp(np.clip(diff @ w, -500, 500)))
        g = -(p @ diff) / batch + ridge * w
        velocity = 0.9 * velocity + 0.1 * g
        square = 0.999 * square + 0.001 * g * g
        w = w - 0.05 * (velocity / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-9)
    strength = x.astype(float) @ w
    # the quantile of the sample's strengths that separates the labels best, both labels counting alike
    order = np.argsort(strength, kind="stable")
    s, y = strength[order], label[order]
    below_bad, below_good = np.concatenate([[0], np.cumsum(y == 0)]), np.concatenate([[0], np.cumsum(y == 1)])
    right = below_bad / len(bad) + 1 - below_good / len(good)
    best = np.flatnonzero(right >= right.max() - 1e-12)
    at = int(best[len(best) // 2])
    cut = s[0] - 1 if at == 0 else s[-1] + 1 if at == len(s) else (s[at - 1] + s[at]) / 2
    return BradleyTerry(w, float(cut), float(max(strength.std(), 1e-9)), at / len(s))


def _features(batches):
    for batch in batches:
        for a, b, data, offs in chunks(batch, "text", PIECE):
            x = features(data, offs)
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([r.tobytes() for r in x], pa.binary())], ["label", "x"])


def fit(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
        sample: int = SAMPLE, pairs: int = PAIRS, seed: int = SEED) -> BradleyTerry:
    """Fit on at most about `sample` labelled documents; rows without id or label, or with another label, are left out.

    Null texts are empty ones.  An id counts once for each of its labels, with
    the smallest of its texts, however often it is repeated, so the sample stays
    bounded; without a row, or with one label only, all scores lie on one side.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).distinct()
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    rate = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, sample / 2 / n))]) if counts else F.create_map(F.lit(0), F.lit(0.0))
    chance = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(chance < rate[F.col("label")])
    # the sample is bounded by its parameter, so it may be broadcast against the documents
    rows = documents.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    got = rows.select("label", "text").mapInArrow(lean(_features), "label int, x binary").toArrow()
    label, raw = got.column("label").to_numpy(), got.column("x").to_pylist()
    order = sorted(range(len(raw)), key=lambda i: (raw[i], label[i]))  # the rows' order must not hang on the order of tasks
    x = np.frombuffer(b"".join(raw[i] for i in order), np.float32).reshape(len(raw), WIDTH)
    return fit_pairs(x, label[order].astype(int), pairs, seed)


def score(documents: DataFrame, model: BradleyTerry, *, text_col: str = "text", score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """documents with score (0 to 1) and predicted (1 from 0.5).

    A null text counts as an empty one, which is scored as well; repeated rows
    are each scored, and an empty table stays empty.  Other columns pass
    through; if one has the name of a new column, other names must be given.
    """
    schema = documents.schema
    if {score_col.lower(), predicted_col.lower()} & {n.lower() for n in schema.names}:
        raise ValueError(f"documents already have {score_col} or {predicted_col}: give other names")

    def run(batches):
        for batch in batches:
            for a, b, data, offs in chunks(batch, text_col, PIECE):
                s = model.score(features(data, offs))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*batch.schema.names, score_col, predicted_col])

    return documents.mapInArrow(lean(run), T.StructType([*schema.fields, T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())]))


def held_out(id_col: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text has this remainder; null ids are never held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))
