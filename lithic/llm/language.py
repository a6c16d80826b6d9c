"""Language identification by a byte convolutional network.

A window of ``WINDOW`` bytes goes through filters of several widths, each over
embedded bytes, max pooling over the window, and a softmax layer.  Because the
first layer stands on single bytes, embedding and filter fold into one table
per byte and tap after training, and for applying it into one table per pair of
bytes; a filter of width 4 is then two lookups and an addition.  The network is
trained in numpy on a bounded sample of labelled texts and applied to all
windows of every whole text in batches; a document's probabilities are the mean
of its windows' log probabilities, weighted by their bytes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import chunks

WINDOW = 256
WIDTHS = (2, 4)
FILTERS = 12
EMBED = 8
SAMPLE = 1500  # texts of each language
WINDOWS_EACH = 3
SEED = 5
UNDETERMINED = "und"

#: A letter of any script.
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class ByteConv:
    langs: list[str]
    embed: np.ndarray  # 256 x EMBED
    filters: list[np.ndarray]  # width x EMBED x FILTERS, for each width
    bias: list[np.ndarray]
    out: np.ndarray  # all filters x langs
    out_bias: np.ndarray
    pairs: list[np.ndarray] = field(default_factory=list)

    def taps(self) -> list[np.ndarray]:
        """For each width: tap x byte x filter."""
        return [np.einsum("be,wef->wbf", self.embed, f) for f in self.filters]

    def fold(self) -> ByteConv:
        """Tables over pairs of bytes, one for each two taps."""
        self.pairs = []
        for t in self.taps():
            for k in range(0, len(t), 2):
                self.pairs.append((t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, -1).astype(np.float32))
        return self

    def pooled(self, x: np.ndarray) -> np.ndarray:
        """Max-pooled filters of windows x (windows x WINDOW bytes); no filter reaches past its window."""
        pair = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
        out, k = [], 0
        for width, bias in zip(WIDTHS, self.bias, strict=True):
            n = x.shape[1] - width + 1
            act = self.pairs[k][pair[:, :n]]
            for j in range(1, width // 2):
                act += self.pairs[k + j][pair[:, 2 * j : 2 * j + n]]
            k += width // 2
            out.append(np.maximum(act.max(1) + bias.astype(np.float32), 0))
        return np.concatenate(out, axis=1)

    def log_softmax(self, h: np.ndarray) -> np.ndarray:
        z = h @ self.out + self.out_bias
        z = z - z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def _forward(net: ByteConv, x: np.ndarray):
    """x: windows x WINDOW bytes. Hidden values and where each filter had its maximum."""
    hidden, where = [], []
    for taps, bias in zip(net.taps(), net.bias, strict=True):
        width = len(taps)
        act = sum(taps[k][x[:, k : x.shape[1] - width + 1 + k]] for k in range(width))
        at = act.argmax(1)
        top = np.take_along_axis(act, at[:, None, :], 1)[:, 0, :] + bias
        hidden.append(top)
        where.append(at)
    return hidden, where


def train(windows: np.ndarray, label: np.ndarray, langs: list[str], seed: int = SEED, epochs: int = 6, batch: int = 64, rate: float = 0.01) -> ByteConv:
    """Adam on cross entropy; the gradient of max pooling goes to the bytes under each maximum only."""
    rng = np.random.default_rng(seed)
    total = FILTERS * len(WIDTHS)
    net = ByteConv(
        langs, rng.normal(0, 0.5, (256, EMBED)), [rng.normal(0, 0.5, (w, EMBED, FILTERS)) for w in WIDTHS],
        [np.zeros(FILTERS) for _ in WIDTHS], rng.normal(0, 0.1, (total, len(langs))), np.zeros(len(langs)),
    )
    params = [net.embed, *net.filters, *net.bias, net.out, net.out_bias]
    first, second, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            x, y = windows[rows], label[rows]
            hidden, where = _forward(net, x)
            h = np.concatenate(hidden, 1)
            relu = np.maximum(h, 0)
            p = np.exp(net.log_softmax(relu))
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            back = (p @ net.out.T) * (h > 0)
            g_embed = np.zeros_like(net.embed)
            g_filters, g_bias = [], []
            for i, width in enumerate(WIDTHS):
                b = back[:, i * FILTERS : (i + 1) * FILTERS]
                g = np.zeros_like(net.filters[i])
                for k in range(width):
                    byte = np.take_along_axis(x, where[i] + k, 1)  # rows x filters
                    g[k] = np.einsum("rfe,rf->ef", net.embed[byte], b)
                    np.add.at(g_embed, byte, b[:, :, None] * net.filters[i][k].T[None, :, :])
                g_filters.append(g)
                g_bias.append(b.sum(0))
            grads = [g_embed, *g_filters, *g_bias, relu.T @ p, p.sum(0)]
            t += 1
            for q, g, m, v in zip(params, grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return net.fold()


def _sampled_windows(seed: int):
    def run(batches):
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            lang, out = [], []
            for name, text in zip(langs, texts, strict=True):
                raw = (text or "").encode()
                n = max(1, -(-len(raw) // WINDOW))
                rng = np.random.default_rng([seed, len(raw)])
                for k in rng.choice(n, min(n, WINDOWS_EACH), replace=False):
                    if piece := raw[k * WINDOW : (k + 1) * WINDOW]:
                        lang.append(name)
                        out.append(piece.ljust(WINDOW, b" "))
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(out, pa.binary())], ["lang", "bytes"])

    return run


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, seed: int = SEED) -> ByteConv | None:
    """Train on about `sample` texts of each language (chosen by a hash of id and text) and up to three windows of each; None without labelled text.

    A null id is an id like others.  Rows that are alike in id, text and language
    count once, so the sample stays bounded however often they are repeated.
    """
    known = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counts = {r[lang_col]: r["count"] for r in known.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    rate = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, sample / n))])
    name = F.xxhash64(id_col, text_col, F.lit(seed))
    chance = F.pmod(name, F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(chance < rate[F.col(lang_col)]).groupBy(lang_col, name.alias("_name")).agg(F.min(text_col).alias("_text"))
    got = chosen.select(lang_col, "_text").mapInArrow(_sampled_windows(seed), "lang string, bytes binary").collect()
    rows = sorted((r["lang"], bytes(r["bytes"])) for r in got)  # the same order whatever the order of tasks
    langs = sorted(counts)
    at = {x: i for i, x in enumerate(langs)}
    x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
    return train(x, np.array([at[r[0]] for r in rows]), langs, seed)


def predict(documents: DataFrame, net: ByteConv | None, *, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """documents with lang_pred and score, from all windows of each whole text.

    `und` with score 0 if the text is null or has no letter, or if nothing was
    learned.  Repeated rows are each answered; an empty table stays empty.  Other
    columns pass through; if one has the name of a new column, other names must
    be given.
    """
    schema = documents.schema
    if {lang_out.lower(), score_out.lower()} & {n.lower() for n in schema.names}:
        raise ValueError(f"documents already have {lang_out} or {score_out}: give other names")
    given = documents.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        model = given.value
        for batch in batches:
            texts = batch.column(schema.names.index(text_col))
            lang, score = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
            if model is not None:
                for a, b, data, offs in chunks(batch, text_col, 1 << 17):
                    best, p = _chunk(model, data, offs)
                    lang[a:b] = best
                    score[a:b] = p
                for i in range(len(texts)):  # one text at a time as a Python string
                    t = texts[i].as_py()
                    if t is None or not _LETTER.search(t):
                        lang[i], score[i] = UNDETERMINED, 0.0
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names, lang_out, score_out])

    return documents.mapInArrow(run, T.StructType([*schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))


def windows_of(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of WINDOW bytes of each row, the last one filled up with spaces as in training; which row each is of, and its own bytes."""
    n = np.diff(offs)
    count = np.maximum(1, -(-n // WINDOW))
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(len(n)), count)
    flat = np.full(int(count.sum()) * WINDOW, 32, np.uint8)
    flat[np.arange(len(data)) + np.repeat(first * WINDOW - offs[:-1], n)] = data
    own = np.minimum(n[row] - (np.arange(len(row)) - first[row]) * WINDOW, WINDOW)
    return flat.reshape(-1, WINDOW), row, own


def _chunk(net: ByteConv, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x, row, own = windows_of(data, offs)
    logs = np.concatenate([net.log_softmax(net.pooled(x[a : a + 256])) for a in range(0, len(x), 256)])
    total = np.add.reduceat(logs * own[:, None], np.searchsorted(row, np.arange(len(offs) - 1)))
    mean = total / np.maximum(np.diff(offs), 1)[:, None]
    p = np.exp(mean - mean.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    best = p.argmax(1)
    return np.array(net.langs, object)[best], p[np.arange(len(p)), best]
