"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; gated attention weighs the encodings; the weighted sum is
scored. Encoder, attention and score are learnt together from labels of documents alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.rolling import buffers
from graphloom.llm.text import or_empty
from graphloom.runtime import prepare_python

#: Bytes of a passage; cells of the hashed byte trigrams; sizes of encoding and attention.
PASSAGE, CELLS, WIDTH, GATE = 512, 1024, 32, 16
#: The classifier is fitted on at most this many labelled documents, of at most this many bytes together and each.
SAMPLE, SAMPLE_BYTES, SAMPLE_TEXT = 4000, 48 << 20, 1 << 20
#: Rounds over the sample, documents and bytes of a step (one document at least), learning rate.
EPOCHS, BATCH, BATCH_BYTES, RATE = 12, 64, 2 << 20, 3e-3
#: Bytes of texts whose passages are held at once in scoring; whole passages.
PIECE = 1024 * PASSAGE
#: Byte classes: control and space, digit, upper case, lower case, non-ASCII, and punctuation.
_CLASS = np.full(256, 5, "int64")
_CLASS[:33], _CLASS[48:58], _CLASS[65:91], _CLASS[97:123], _CLASS[128:] = 0, 1, 2, 3, 4
FEATURES = CELLS + 7


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of the texts, and the number of passages of each text (one at least)."""
    lengths = np.array([len(t) for t in texts], "int64")
    counts = np.maximum(-(-lengths // PASSAGE), 1)
    data = np.frombuffer(b"".join(texts), "uint8")
    first = np.concatenate(([0], np.cumsum(counts)))
    begin = np.repeat(np.cumsum(lengths) - lengths, lengths)
    owner = np.repeat(first[:-1], lengths) + (np.arange(len(data)) - begin) // PASSAGE
    n = int(first[-1])
    wide = data.astype("uint32")
    tri = wide[:-2] * np.uint32(0x9E3779B1) ^ wide[1:-1] * np.uint32(0x85EBCA77) ^ wide[2:] * np.uint32(0xC2B2AE3D)
    cell = ((tri * np.uint32(0x27D4EB2F)) >> np.uint32(22)).astype("int64")
    inside = owner[:-2] == owner[2:]
    grams = np.bincount(owner[:-2][inside] * CELLS + cell[inside], minlength=n * CELLS).reshape(n, CELLS).astype("float32")
    classes = np.bincount(owner * 6 + _CLASS[data], minlength=n * 6).reshape(n, 6).astype("float32")
    size = np.maximum(classes.sum(1, keepdims=True), 1)
    variety = (grams > 0).sum(1, keepdims=True) / np.maximum(grams.sum(1, keepdims=True), 1)
    roots = np.sqrt(grams)
    roots *= 4 / np.maximum(np.sqrt(grams.sum(1, keepdims=True)), 1)
    return np.hstack((roots, 3 * classes / size, 3 * variety)).astype("float32"), counts


def _batches(order: np.ndarray, texts: list[bytes]) -> Iterator[list[int]]:
    some: list[int] = []
    size = 0
    for i in order.tolist():
        if some and (len(some) == BATCH or size + len(texts[i]) > BATCH_BYTES):
            yield some
            some, size = [], 0
        some.append(i)
        size += len(texts[i])
    if some:
        yield some


class Attention:
    """h = tanh(x W + b); a = softmax over the bag of (tanh(h V) * sigmoid(h U)) w; score = sigmoid(sum(a h) c + d)."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype("float32")
        self.p = {
            "W": draw(FEATURES, WIDTH), "b": np.zeros(WIDTH, "float32"), "V": draw(WIDTH, GATE), "U": draw(WIDTH, GATE),
            "w": draw(GATE, 1), "c": draw(WIDTH, 1), "d": np.zeros(1, "float32"),
        }

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict:
        p, begin = self.p, np.concatenate(([0], np.cumsum(counts)[:-1]))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        s = ((t * g) @ p["w"])[:, 0]
        top = np.maximum.reduceat(s, begin)
        e = np.exp(s - np.repeat(top, counts))
        mass = np.add.reduceat(e, begin)
        a = e / np.repeat(mass, counts)
        z = np.add.reduceat(a[:, None] * h, begin)
        y = 1 / (1 + np.exp(-np.clip((z @ p["c"])[:, 0] + p["d"], -30, 30)))
        return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "begin": begin, "top": top, "mass": mass}

    def gradients(self, x: np.ndarray, counts: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict:
        p, f = self.p, self.forward(x, counts)
        do = ((f["y"] - label) * weight / len(label)).astype("float32")
        dz = np.repeat(do[:, None] * p["c"].T, counts, axis=0)
        da = (dz * f["h"]).sum(1)
        ds = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["begin"]), counts))
        dtg = ds[:, None] * p["w"].T
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = dz * f["a"][:, None] + dt @ p["V"].T + dg @ p["U"].T
        dx = dh * (1 - f["h"] ** 2)
        return {
            "W": x.T @ dx, "b": dx.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": ((f["t"] * f["g"]).T @ ds)[:, None],
            "c": f["z"].T @ do[:, None], "d": do.sum(keepdims=True),
        }

    def fit(self, texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Attention:
        """Adam over shuffled batches; either class weighs the same."""
        r, m, v, step = np.random.default_rng(seed), {}, {}, 0
        share = np.array([max((labels == k).mean(), 1e-3) for k in (0, 1)])
        for _ in range(epochs):
            for some in _batches(r.permutation(len(texts)), texts):
                x, counts = passages([texts[i] for i in some])
                y = labels[some]
                step += 1
                for k, g in self.gradients(x, counts, y, 0.5 / share[y]).items():
                    g = g + 1e-4 * self.p[k] * (k == "W")
                    m[k] = 0.9 * m.get(k, 0) + 0.1 * g
                    v[k] = 0.999 * v.get(k, 0) + 0.001 * g * g
                    rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    self.p[k] -= (rate * m[k] / (np.sqrt(v[k]) + 1e-8)).astype("float32")
        return self

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """As ``forward``, in pieces of whole passages: the softmax over a long text's passages is summed piece by piece."""
        owner = [i for i, t in enumerate(texts) for _ in range(0, max(len(t), 1), PIECE)]
        pieces = [t[lo : lo + PIECE] for t in texts for lo in range(0, max(len(t), 1), PIECE)]
        top, mass = np.full(len(texts), -np.inf), np.zeros(len(texts))
        z = np.zeros((len(texts), WIDTH))
        for lo, hi in buffers(pieces, PIECE):
            f = self.forward(*passages(pieces[lo:hi]))
            for k, i in enumerate(owner[lo:hi]):
                new = max(top[i], float(f["top"][k]))
                old, own = np.exp(top[i] - new), np.exp(f["top"][k] - new) * f["mass"][k]
                top[i], mass[i], z[i] = new, mass[i] * old + own, z[i] * old + own * f["z"][k]
        return 1 / (1 + np.exp(-np.clip((z / mass[:, None] @ self.p["c"])[:, 0] + self.p["d"], -30, 30)))


def fold(key: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % n


def fit_sample(docs: DataFrame, labels: DataFrame, may_learn: Column, key: str = "doc_id", text: str = "text", label: str = "quality") -> Attention:
    """A classifier fitted on a bounded sample: the labelled documents with the smallest digests of their ids.

    Documents longer than SAMPLE_TEXT or that no longer fit into SAMPLE_BYTES are passed over, those after them are not.
    Null texts count as empty; null ids and labels other than 0 and 1 teach nothing. Of rows repeated with one id the
    smallest text counts, of its labels the largest. Labels of one class give a classifier that leans to it. Without
    labelled documents nothing is fitted, and scores are arbitrary; if there are some and none fits, that is an error.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.max(label).alias("y"))
    own = docs.filter(may_learn).select(F.col(key).alias("id"), F.octet_length(or_empty(text)).alias("size"))
    picked = own.join(known, "id").orderBy(F.md5(F.col("id").cast("string")), "size").limit(SAMPLE).toPandas()
    if picked.empty:
        return Attention()
    fits, left = [], SAMPLE_BYTES
    for size in picked["size"].tolist():
        fits.append(size <= min(left, SAMPLE_TEXT))
        left -= size * fits[-1]
    picked = picked[fits].drop_duplicates("id")
    if picked.empty:
        raise ValueError(f"none of the labelled documents has at most {SAMPLE_BYTES} bytes")
    ids = docs.sparkSession.createDataFrame(picked[["id", "y"]])
    fitting = docs.select(F.col(key).alias("id"), or_empty(text).alias("t")).filter(F.octet_length("t") <= SAMPLE_TEXT)
    rows = fitting.join(F.broadcast(ids), "id")
    rows = rows.groupBy("id").agg(F.min("t").alias("t"), F.first("y").alias("y")).toPandas().sort_values("id")
    return Attention().fit([t.encode() for t in rows["t"]], rows["y"].to_numpy("int64"))


def classify(docs: DataFrame, model: Attention, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``key``, score, predicted. Null text counts as empty: a bag of one empty passage.

    Every passage of a text counts, however long it is; PIECE bytes are held at once. Repeated rows get equal scores; an
    empty table gives no rows.
    """
    prepare_python(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t.encode() for t in batch.column("t").to_pylist()]
            y = model.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(y), pa.array((y >= 0.5).astype("int32"))], ["id", "score", "predicted"])

    d = docs.select(F.col(key).alias("id"), or_empty(text).alias("t"))
    return d.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", key)
