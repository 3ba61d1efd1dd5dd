"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of 64 words. Every passage is encoded by a small network from shares of character-class
pairs and word statistics; gated attention gives each passage a weight; the weighted sum of the encodings is scored.
All parts are trained together, from the documents' labels alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waraq.llm.textops import bounded_sample, by_bytes, fold_of, utf8_of
from waraq.llm.words import SOLID_BYTES, word_hashes
from waraq.runtime import bound_batches

PASSAGE_WORDS = 64
CLASSES = 12
#: Space, newline, lower, upper, digit, full stop and comma, ! and ?, quotes and brackets, | - _ / \, # $ % & * + = ~ ^ @ < >, beyond ASCII, other.
_GROUPS = (" ", "\n", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:", "!?", "\"'()[]{}`", "|-_/\\", "#$%&*+=~^@<>")
_CLASS_OF = np.full(256, 11, np.uint8)
for _k, _chars in enumerate(_GROUPS):
    for _c in _chars:
        _CLASS_OF[ord(_c)] = _k
_CLASS_OF[128:] = 10
LAGS = 4
FEATURES = CLASSES * CLASSES + LAGS + 2


def passage_features(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(passages, FEATURES) float32 and the rows' offsets into it. A text without words is one passage of zeros."""
    data, offsets = utf8_of(array)
    hashes, starts, word_at = word_hashes(data, offsets, SOLID_BYTES)
    words = np.diff(word_at)
    passages = np.maximum(1, -(-words // PASSAGE_WORDS))
    base = np.r_[0, passages.cumsum()]
    out = np.zeros((base[-1], FEATURES), np.float32)
    if not len(starts):
        return out, base
    row = np.repeat(np.arange(len(words)), words)
    place = np.arange(len(starts)) - word_at[row]
    passage = base[row] + place // PASSAGE_WORDS
    opens = np.flatnonzero(np.r_[True, passage[1:] != passage[:-1]])
    first_byte = starts[opens]
    last_byte = np.r_[first_byte[1:], len(data)]
    last_byte = np.minimum(last_byte, offsets[row[opens] + 1])
    kinds = _CLASS_OF[data]
    owner = np.full(len(data), -1, np.int64)
    length = last_byte - first_byte
    at = np.repeat(first_byte - np.r_[0, length.cumsum()[:-1]], length) + np.arange(length.sum())
    owner[at] = np.repeat(passage[opens], length)
    pair = kinds[:-1].astype(np.int64) * CLASSES + kinds[1:]
    good = (owner[:-1] >= 0) & (owner[:-1] == owner[1:])
    hist = np.bincount(owner[:-1][good] * (CLASSES * CLASSES) + pair[good], minlength=len(out) * CLASSES * CLASSES)
    shares = hist.reshape(len(out), -1)
    out[:, : CLASSES * CLASSES] = np.sqrt(shares / np.maximum(1, shares.sum(axis=1, keepdims=True)))
    n = np.bincount(passage, minlength=len(out))
    for lag in range(1, LAGS + 1):
        same = (hashes[lag:] == hashes[:-lag]) & (passage[lag:] == passage[:-lag])
        out[:, CLASSES * CLASSES + lag - 1] = np.bincount(passage[lag:][same], minlength=len(out)) / np.maximum(1, n)
    size = np.bincount(passage[opens], weights=length, minlength=len(out))
    out[:, -2] = np.log1p(n) / 4
    out[:, -1] = np.log1p(size / np.maximum(1, n)) / 2
    return out, base


class AttentionModel:
    """h = tanh(x W + b); a = softmax over the bag of w . (tanh(h V) * sigmoid(h U)); score = sigmoid(c . sum(a h) + d)."""

    def __init__(self, hidden: int = 24, gate: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s)
        self.p = {"W": draw(FEATURES, hidden), "b": np.zeros(hidden), "V": draw(hidden, gate), "U": draw(hidden, gate), "w": draw(gate), "c": draw(hidden), "d": np.zeros(1)}

    def forward(self, x: np.ndarray, base: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        t = np.tanh(h @ p["V"])
        s = 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        bag = np.repeat(np.arange(len(base) - 1), np.diff(base))
        e = np.exp(e - np.maximum.reduceat(e, base[:-1])[bag])
        a = e / np.add.reduceat(e, base[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, base[:-1])
        return {"h": h, "t": t, "s": s, "a": a, "bag": bag, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["d"])))}

    def gradients(self, x: np.ndarray, base: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.p, self.forward(x, base)
        dl = (f["y"] - y) / len(y)
        dz = dl[:, None] * p["c"]
        bag, a, h, t, s = f["bag"], f["a"], f["h"], f["t"], f["s"]
        dh = a[:, None] * dz[bag]
        da = (dz[bag] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, base[:-1])[bag])
        dt, ds = de[:, None] * p["w"] * s, de[:, None] * p["w"] * t
        gv, gu = dt * (1 - t * t), ds * s * (1 - s)
        dh += gv @ p["V"].T + gu @ p["U"].T
        dx = dh * (1 - h * h)
        return {"W": x.T @ dx, "b": dx.sum(axis=0), "V": h.T @ gv, "U": h.T @ gu, "w": (t * s).T @ de, "c": f["z"].T @ dl, "d": dl.sum(keepdims=True)}

    def fit(self, x: np.ndarray, base: np.ndarray, y: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 3) -> AttentionModel:
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(u) for k, u in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(y))
            for at in range(0, len(y), batch):
                pick = order[at : at + batch]
                sizes = base[pick + 1] - base[pick]
                rows = np.repeat(base[pick] - np.r_[0, sizes.cumsum()[:-1]], sizes) + np.arange(sizes.sum())
                g = self.gradients(x[rows].astype(np.float64), np.r_[0, sizes.cumsum()], y[pick])
                step += 1
                lr = rate * (1 - epoch / epochs)
                for k in self.p:
                    grad = g[k] + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * grad
                    v[k] = 0.99 * v[k] + 0.01 * grad * grad
                    self.p[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return self


def _features_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in by_bytes(batches, 1):
        x, base = passage_features(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(np.diff(base)), pa.array([x[a:b].astype(np.float16).tobytes() for a, b in zip(base[:-1], base[1:])], pa.binary())], ["y", "n", "x"]
        )


def learn(docs: DataFrame, labels: DataFrame, train_docs: int = 4000, train_bytes: int = 50_000) -> AttentionModel | None:
    """Train on about ``train_docs`` labelled documents with crc32(doc_id) mod 5 <> 0; None if there are none.

    Labels other than 0 and 1 are left out. Documents of more than ``train_bytes`` bytes are not learned from, and of
    rows that repeat an id one is, so the driver holds at most about ``train_docs * train_bytes`` bytes of features.
    """
    bound_batches(docs.sparkSession)
    known = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter("y in (0, 1)").filter(fold_of(F.col("doc_id"), 5) != 0)
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    sample = bounded_sample(known, F.col("doc_id"), known.count(), train_docs)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter(F.octet_length("text") <= train_bytes)
    rows = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("y").cast("double").alias("y"), F.min("text").alias("text")).select("y", "text")
    table = rows.mapInArrow(_features_rows, "y double, n long, x binary").toPandas()
    if not len(table):
        return None
    table = table.groupby("x", as_index=False).agg({"y": "mean", "n": "first"}).sort_values(["n", "x"]).reset_index(drop=True)  # copies teach once, by their mean label; the order is fixed
    x = np.frombuffer(b"".join(table["x"]), np.float16).reshape(-1, FEATURES)
    return AttentionModel().fit(x, np.r_[0, table["n"].to_numpy().cumsum()], table["y"].to_numpy())


def _score_rows(model: AttentionModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 2, 4 << 20):
            if model is None:
                score = np.full(batch.num_rows, 0.5)
            else:
                score = model.forward(*passage_features(batch.column(2)))["y"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score.astype(np.float64))], ["doc_id", "held_out", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``, from whole texts only.

    Null and empty texts: one passage without words, scored like any other. Very long texts: all their passages count.
    Null ids, ties and repeated rows: scored alike. No labels to learn from: 0.5. Empty table: no rows.
    """
    bound_batches(docs.sparkSession)
    model = learn(docs, labels, **options)
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "text")
    scored = rows.mapInArrow(_score_rows(model), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
