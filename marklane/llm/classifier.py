"""Attention-based multiple-instance learning of document quality.

A document is a bag of passages. Every passage is encoded by its hashed byte
trigrams and statistics of its bytes and words, through a layer learned with the rest; gated
attention, learned from document labels alone, weighs the passages, and a
logistic unit scores the weighted representation.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import field, map_rows, materialise

PASSAGE_BYTES = 600
#: Bound of the labelled sample: so many documents, and no further one once their passages (all of each document) are so many.
TRAIN_DOCS, TRAIN_ROWS = 6000, 400_000
#: Buckets of hashed byte trigrams.
GRAMS = 64
HIDDEN, ATTENTION, EPOCHS = 24, 12, 60
THRESHOLD = 0.7

_KIND = np.zeros(256, np.int64)
for _i, _chars in enumerate((range(0x61, 0x7B), range(0x41, 0x5B), range(0x30, 0x3A), range(0x80, 0x100), b" ", b"\n\r\t", b".,;:?'\"()-", b"!")):
    for _c in _chars:
        _KIND[_c] = _i + 1
_KINDS = 9
_FOLD = np.arange(256, dtype=np.uint32)  # A-Z count as a-z in trigrams
_FOLD[0x41:0x5B] += 32


def passages(raw: bytes) -> list[bytes]:
    """The whole text in parts of about PASSAGE_BYTES, cut at spaces where there are any. An empty text is one empty part."""
    out, at = [], 0
    while len(raw) - at > PASSAGE_BYTES * 3 // 2:
        cut = raw.rfind(b" ", at + PASSAGE_BYTES // 2, at + PASSAGE_BYTES)
        cut = cut if cut > 0 else at + PASSAGE_BYTES
        out.append(raw[at:cut])
        at = cut
    out.append(raw[at:])
    return out


def encode(text: str | None) -> np.ndarray:
    """A row of features for each passage of a text; null counts as empty."""
    raw = (text or "").encode("utf-8", "replace")
    parts = passages(raw)
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    kinds = _KIND[np.frombuffer(raw, np.uint8)]
    owner = np.repeat(np.arange(len(parts)), size)
    counts = np.bincount(owner * _KINDS + kinds, minlength=len(parts) * _KINDS).reshape(-1, _KINDS)
    share = counts / np.maximum(size, 1)[:, None]
    low = _FOLD[np.frombuffer(raw, np.uint8)]
    grams = np.zeros((len(parts), GRAMS))
    if len(low) > 2:
        hashed = (low[:-2] << np.uint32(16) | low[1:-1] << np.uint32(8) | low[2:]) * np.uint32(0x9E3779B1) >> np.uint32(32 - GRAMS.bit_length() + 1)
        within = owner[:-2] == owner[2:]  # a trigram lies in one passage
        grams = np.bincount((owner[:-2] * GRAMS + hashed)[within], minlength=len(parts) * GRAMS).reshape(-1, GRAMS) / np.maximum(size - 2, 1)[:, None]
    rest = np.empty((len(parts), 9))
    all_words, all_lines = raw.split(), raw.split(b"\n")
    doc = (len(set(all_words)) / max(1, len(all_words)), len(set(all_lines)) / max(1, len(all_lines)), np.log1p(len(raw)) / 10)
    for i, p in enumerate(parts):
        words = p.split()
        n = max(1, len(words))
        distinct = len(set(words))
        twice = sum(map(bytes.__eq__, words[1:], words[:-1]))
        short = sum(len(w) <= 3 for w in words)
        rest[i] = (len(p) / PASSAGE_BYTES, distinct / n, twice / n, short / n, len(p) / n / 10, len(zlib.compress(p, 1)) / (len(p) + 20), *doc)
    return np.hstack([np.sqrt(share), rest, np.sqrt(grams)]).astype(np.float32)


N_FEATURES = _KINDS + 9 + GRAMS


@dataclass
class Model:
    """Standardisation, encoder, gated attention and output unit."""

    mean: np.ndarray
    sd: np.ndarray
    p: dict[str, np.ndarray]

    def bags(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """Scores of bags; bag i has the rows of ``x`` from starts[i] on. Every bag has a row."""
        p, sizes = self.p, np.diff(np.r_[starts, len(x)])
        z = (x - self.mean) / self.sd
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        bag = np.add.reduceat(a[:, None] * h, starts)
        s = 1 / (1 + np.exp(-np.clip(bag @ p["c"] + p["d"], -30, 30)))
        return {"z": z, "h": h, "t": t, "g": g, "a": a, "bag": bag, "score": s, "sizes": sizes}


def fit(x: np.ndarray, starts: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Adam on the logistic loss of bag labels, classes weighted alike."""
    rng = np.random.default_rng(seed)
    d = x.shape[1]
    p = {
        "W": rng.normal(0, d**-0.5, (d, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "U": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "w": rng.normal(0, 0.3, ATTENTION), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1),
    }
    mean, sd = x.mean(axis=0), x.std(axis=0) + 1e-3
    model = Model(mean, sd, p)
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    ends = np.r_[starts[1:], len(x)]
    weight = np.where(y == 1, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    for _ in range(EPOCHS):
        order = rng.permutation(len(starts))
        for at in range(0, len(order), 256):
            chosen = order[at : at + 256]
            sizes = ends[chosen] - starts[chosen]
            s0 = np.cumsum(sizes) - sizes
            rows = np.repeat(starts[chosen] - s0, sizes) + np.arange(sizes.sum())
            f = model.bags(x[rows], s0)
            dout = (f["score"] - y[chosen]) * weight[chosen] / len(chosen)
            grad = {"c": f["bag"].T @ dout, "d": dout.sum(keepdims=True)}
            dbag = np.repeat(dout[:, None] * p["c"], sizes, axis=0)
            da = (dbag * f["h"]).sum(axis=1)
            inner = np.repeat(np.add.reduceat(da * f["a"], s0), sizes)
            de = f["a"] * (da - inner)
            dt, dg = de[:, None] * p["w"] * f["g"], de[:, None] * p["w"] * f["t"]
            grad["w"] = (f["t"] * f["g"]).T @ de
            dt, dg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
            grad["V"], grad["U"] = f["h"].T @ dt, f["h"].T @ dg
            dh = (dbag * f["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T) * (1 - f["h"] ** 2)
            grad["W"], grad["b"] = f["z"].T @ dh, dh.sum(axis=0)
            step += 1
            for k, g in grad.items():
                g = g + 1e-4 * p[k]
                m1[k] = 0.9 * m1[k] + 0.1 * g
                m2[k] = 0.999 * m2[k] + 0.001 * g * g
                p[k] -= 0.01 * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.999**step)) + 1e-8)
    return model


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = TRAIN_DOCS, rows: int = TRAIN_ROWS, text: str = "text") -> Model:
    """Fit on at most ``most`` labelled documents, taken whole in the order of a hash of doc_id.

    ``labels`` holds the rows that may be learned from. All passages of a chosen document are learned from; no further
    document is chosen once ``rows`` passages are reached, so what comes to the driver is bounded by the sample. Null labels and
    ids are ignored, ids that repeat in ``labels`` count once (with the larger label), rows that repeat an id in ``docs`` are documents each, null and
    empty texts are one empty passage; without both classes the
    model scores every text with the only label's value, or 0.5 without any.
    """
    chosen = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    bags = docs.select("doc_id", F.col(text).alias("t")).join(F.broadcast(chosen), "doc_id")

    def make():
        def fn(batch: pa.RecordBatch):
            xs = [encode(t) for t in batch.column(1).to_pylist()]
            return [pa.array([x.tobytes() for x in xs], pa.binary()), pa.array([len(x) for x in xs], pa.int64())]

        return fn

    encoded = materialise(map_rows(bags, make, [field("x", T.BinaryType()), field("n", T.LongType())], "t", ("t",)))
    order = W.orderBy(F.xxhash64("doc_id"), "doc_id", "n", F.xxhash64("x"))  # over the sample alone
    before = F.coalesce(F.sum("n").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    found = encoded.withColumn("before", before).where(F.col("before") < rows).orderBy("before").select("y", "x").collect()
    y = np.array([r["y"] for r in found])
    if len(set(y)) < 2:
        even = float(y[0]) if len(y) else 0.5
        p = {"W": np.zeros((N_FEATURES, 1)), "b": np.zeros(1), "V": np.zeros((1, 1)), "U": np.zeros((1, 1)), "w": np.zeros(1), "c": np.zeros(1), "d": np.array([60 * even - 30.0])}
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), p)
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES) for r in found]
    sizes = np.fromiter(map(len, xs), np.int64, len(xs))
    return fit(np.concatenate(xs).astype(np.float64), np.cumsum(sizes) - sizes, y)


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Append ``out``, the score of each whole text (0 to 1); null and empty texts are scored as one empty passage.

    Equal texts get equal scores; a column named like ``out`` is replaced, the others stay. No shuffle.
    """
    at = docs.columns.index(text)

    def make():
        def fn(batch: pa.RecordBatch):
            xs = [encode(t) for t in batch.column(at).to_pylist()]
            sizes = np.fromiter(map(len, xs), np.int64, len(xs))
            if not len(xs):
                return [pa.array([], pa.float64())]
            return [pa.array(model.bags(np.concatenate(xs), np.cumsum(sizes) - sizes)["score"], pa.float64())]

        return fn

    return map_rows(docs, make, [field(out, T.DoubleType())], text)


def held_out(doc_id: str = "doc_id"):
    """True for rows that are never learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))
