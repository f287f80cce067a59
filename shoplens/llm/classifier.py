"""Operator 9 — quality classifier by attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Each passage is encoded
(rates of character classes, word and repetition figures, a hashed profile of
byte pairs, then a learned layer); gated attention learned from the document
labels alone weighs the passages; the weighted passage representation is
scored. So a document that is junk in one part only can be told by that part.

    h_k = tanh(W x_k + b)      a_k = softmax_k( w . (tanh(V h_k) * sigmoid(U h_k)) )
    score = sigmoid( c . sum_k a_k h_k + d )

The model is fitted in numpy on the driver from at most ``sample`` labelled
documents (those with the least hash of their id) and at most
``sample_passages`` passages of each, evenly spaced; both are bounds on the
fitting only. Scoring reads every passage of every text.

Inputs are texts alone. Cases: a null or empty text is one empty passage; null
labels and ids are not learned from; with no label, or labels of one kind, the
score is the smoothed share of label 1; repeated rows are scored alike, row by
row; an empty table gives no rows; other columns are not read by a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PASSAGE = 64
_PROFILE = 32


def _classes() -> np.ndarray:
    """Byte value -> class: 0 lower case, 1 upper case, 2 digit, 3 space, 4 line
    end, 5 sentence mark, 6 bracket or quote, 7 other mark, 8 lead byte beyond
    ASCII, 9 later byte of a character."""
    c = np.full(256, 7, np.uint8)
    c[ord("a"):ord("z") + 1], c[ord("A"):ord("Z") + 1], c[ord("0"):ord("9") + 1] = 0, 1, 2
    c[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], c[0x0A] = 3, 4
    c[[ord(x) for x in ".,;:?-"]], c[[ord(x) for x in "()[]{}'\""]] = 5, 6
    c[0xC0:], c[0x80:0xC0] = 8, 9
    return c


_CLASS = _classes()
_N_CLASSES = 10
FEATURES = _N_CLASSES + 6 + _PROFILE


def passages(text: str, most: int | None = None) -> np.ndarray:
    """Figures of each passage, one row each; of ``most`` evenly spaced ones if given."""
    raw = text.encode("utf-8")
    words = raw.split()
    if not words:
        empty = np.zeros((1, FEATURES), np.float32)
        empty[0, _N_CLASSES] = 1
        return empty
    data = np.frombuffer(raw, np.uint8)
    cls = _CLASS[data]
    inside = (cls != 3) & (cls != 4)
    first = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))[::PASSAGE]
    first[0] = 0
    n = len(first)
    sizes = np.diff(np.append(first, len(data)))
    owner = np.repeat(np.arange(n), sizes)
    counts = np.bincount(owner * _N_CLASSES + cls, minlength=n * _N_CLASSES).reshape(n, _N_CLASSES)
    pair = (data[:-1].astype(np.uint32) * 31 + data[1:]) * np.uint32(2654435761) >> np.uint32(27)
    profile = np.bincount(owner[1:] * _PROFILE + pair, minlength=n * _PROFILE).reshape(n, _PROFILE)
    figures = np.zeros((n, 6))
    before: set = set()
    for k in range(n):
        part = words[k * PASSAGE:(k + 1) * PASSAGE]
        own = set(part)
        figures[k, 1:5] = (len(own) / len(part), len(own & before) / len(own), len(part) / PASSAGE,
                           sum(a == b for a, b in zip(part, part[1:])) / len(part))
        before |= own
    figures[:, 5] = np.log1p(sizes / (figures[:, 3] * PASSAGE))
    rate = sizes[:, None]
    x = np.concatenate([np.sqrt(counts / rate), figures, np.sqrt(profile / rate)], axis=1).astype(np.float32)
    if most and n > most:
        x = x[np.linspace(0, n - 1, most).astype(int)]
    return x


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: dict | None
    rate: float = 0.5

    def scores(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Scores of bags: rows of ``x`` in order, ``sizes`` rows each."""
        if self.weights is None or not len(sizes):
            return np.full(len(sizes), self.rate)
        return _forward(self.weights, (x - self.mean) / self.scale, sizes)["p"]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _forward(m: dict, x: np.ndarray, sizes: np.ndarray) -> dict:
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    h = np.tanh(x @ m["W"] + m["b"])
    t, g = np.tanh(h @ m["V"]), _sigmoid(h @ m["U"])
    e = (t * g) @ m["w"]
    top = np.repeat(np.maximum.reduceat(e, starts), sizes)
    a = np.exp(e - top)
    a /= np.repeat(np.add.reduceat(a, starts), sizes)
    z = np.add.reduceat(a[:, None] * h, starts, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": _sigmoid(z @ m["c"] + m["d"])}


def _gradient(m: dict, x: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> dict:
    f = _forward(m, x, sizes)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    err = (f["p"] - y) / len(y)
    dz = np.repeat(err[:, None] * m["c"], sizes, axis=0)
    a, h, t, g = f["a"], f["h"], f["t"], f["g"]
    da = (dz * h).sum(1)
    de = a * (da - np.repeat(np.add.reduceat(a * da, starts), sizes))
    dt, dg = de[:, None] * m["w"] * g * (1 - t * t), de[:, None] * m["w"] * t * g * (1 - g)
    dh = (a[:, None] * dz + dt @ m["V"].T + dg @ m["U"].T) * (1 - h * h)
    return {"W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de,
            "c": f["z"].T @ err, "d": err.sum()}


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 16, gate: int = 8, rounds: int = 40,
        batch: int = 256, rate: float = 0.01, decay: float = 1e-4, seed: int = 9) -> Model:
    """Fit by Adam on the logarithmic loss; the same input gives the same model."""
    y = np.asarray(labels, float)
    share = (y.sum() + 1) / (len(y) + 2)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(FEATURES), np.ones(FEATURES), None, float(share))
    every = np.concatenate(bags).astype(float)
    mean, scale = every.mean(0), every.std(0) + 1e-3
    bags = [(b - mean) / scale for b in bags]
    rng = np.random.default_rng(seed)
    m = {"W": rng.normal(0, FEATURES ** -0.5, (FEATURES, hidden)), "b": np.zeros(hidden),
         "V": rng.normal(0, hidden ** -0.5, (hidden, gate)), "U": rng.normal(0, hidden ** -0.5, (hidden, gate)),
         "w": rng.normal(0, gate ** -0.5, gate), "c": rng.normal(0, hidden ** -0.5, hidden),
         "d": np.array(np.log(share / (1 - share)))}
    first, second, step = {k: 0 * v for k, v in m.items()}, {k: 0 * v for k, v in m.items()}, 0
    total = rounds * -(-len(y) // batch)
    for _ in range(rounds):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            part, step = order[at:at + batch], step + 1
            grad = _gradient(m, np.concatenate([bags[i] for i in part]), np.array([len(bags[i]) for i in part]), y[part])
            pace = rate * (1 - step / (total + 1))
            for k in m:
                d = grad[k] + decay * m[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.999 * second[k] + 0.001 * d * d
                m[k] = m[k] - pace * (first[k] / (1 - 0.9 ** step)) / (np.sqrt(second[k] / (1 - 0.999 ** step)) + 1e-8)
    return Model(mean, scale, m)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _bags(most: int):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = [passages(t.as_py() or "", most).astype("<f4").tobytes() for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(x, pa.binary())], names=["doc_id", "label", "x"])

    return run


def train(docs: DataFrame, labels: DataFrame, sample: int = 5000, sample_passages: int = 48) -> Model:
    """The model from at most ``sample`` documents of ``docs`` (doc_id, text) with
    ``labels`` (doc_id, quality), held-out ids left aside."""
    chosen = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label"))
              .filter("doc_id IS NOT NULL AND label IN (0, 1)").filter(~held_out(F.col("doc_id")))
              .groupBy("doc_id").agg(F.max("label").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the chosen rows are at most ``sample``: safe to broadcast, and their bags to collect
    rows = (texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")
            .mapInArrow(_bags(sample_passages), "doc_id long, label int, x binary")
            .orderBy("doc_id", "x").limit(sample).collect())
    bags = [np.frombuffer(bytes(r.x), "<f4").reshape(-1, FEATURES) for r in rows]
    return fit(bags, np.array([r.label for r in rows]))


def _scored(model: Model):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            scores: list = []
            for at in range(0, b.num_rows, 256):
                bags = [passages(t.as_py() or "") for t in b.column(0).slice(at, 256)]
                sizes = np.array([len(x) for x in bags])
                scores += model.scores(np.concatenate(bags).astype(float), sizes).tolist() if bags else []
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(scores, pa.float64())],
                                             names=[*b.schema.names[1:], "quality_score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1, higher: label 1 likelier); ``text`` is kept too."""
    own = [c for c in docs.columns if c != "quality_score"]
    kept = [F.col(f"`{c}`") for c in own]
    rows = docs.select(F.col("text").cast("string").alias("mil_text"), *kept)
    return rows.mapInArrow(_scored(model), docs.select(*kept, F.lit(0.0).alias("quality_score")).schema)
