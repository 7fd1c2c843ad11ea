"""Text quality by a byte-level convolutional network in numpy (operator 10).

The network reads bytes as one-hot vectors: every filter has a weight for each byte value at each of its
positions, so a convolution is a sum of table rows. A document is cut into overlapping chunks that cover
all of it; each filter is max-pooled within a chunk, and the chunks' maxima are averaged and maximised
over the document. A logistic layer combines both. It is trained by Adam on a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mattelake.llm.common import id_bucket, spread
from mattelake.llm.toxicity import sample

CHUNK, OVERLAP = 512, 32
WIDTH, STRIDE, FILTERS = 6, 1, 24
#: Bounds of the training sample: expected documents, and expected bytes of them; texts are taken whole.
SAMPLE_DOCS, SAMPLE_BYTES = 2000, 1 << 26
EPOCHS, BATCH, RATE, DECAY = 6, 64, 0.01, 1e-4


def chunks(text: bytes) -> np.ndarray:
    """(chunks, CHUNK) bytes; the last one is padded with zeros. Empty text: one chunk of zeros."""
    step = CHUNK - OVERLAP
    n = max(1, -(-max(0, len(text) - OVERLAP) // step))
    flat = np.zeros((n - 1) * step + CHUNK, np.uint8)
    flat[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[::step]


class Model:
    """tables (WIDTH, 256, FILTERS), bias (FILTERS), out (2 * FILTERS + 1)."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.out = np.concatenate([rng.normal(0, 0.1, 2 * FILTERS), [0.0]]).astype(np.float32)

    def responses(self, x: np.ndarray) -> np.ndarray:
        """(chunks, positions, FILTERS) of chunks (chunks, CHUNK), before bias and rectifier."""
        last = x.shape[1] - WIDTH + 1
        total = self.tables[0][x[:, 0:last:STRIDE]]
        for j in range(1, WIDTH):
            total += self.tables[j][x[:, j : last + j : STRIDE]]
        return total

    def pooled(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        """(chunks, FILTERS): rectified maxima within each chunk."""
        top = [self.responses(x[lo : lo + block]).max(axis=1) for lo in range(0, len(x), block)]
        return np.maximum(np.concatenate(top) + self.bias, 0)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        """One probability per text. Chunks of several texts are convolved together, in bounded blocks."""
        out, held, size = [], [], 0

        def settle():
            ends = np.cumsum([len(c) for c in held])
            top = self.pooled(np.concatenate(held))
            at = np.concatenate([[0], ends[:-1]])
            doc = np.concatenate([np.add.reduceat(top, at) / np.diff(ends, prepend=0)[:, None], np.maximum.reduceat(top, at)], axis=1)
            z = doc @ self.out[:-1] + self.out[-1]
            out.append(1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30))))

        for t in texts:
            held.append(chunks(t))
            size += len(held[-1])
            if size >= 512:
                settle()
                held, size = [], 0
        if held:
            settle()
        return np.concatenate(out) if out else np.empty(0)

    def peaks(self, x: np.ndarray, block: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, FILTERS) position and value of each filter's largest response, before bias and rectifier."""
        where, top = [], []
        for lo in range(0, len(x), block):
            act = self.responses(x[lo : lo + block])
            at = act.argmax(axis=1)
            where.append(at)
            top.append(np.take_along_axis(act, at[:, None], axis=1)[:, 0])
        return np.concatenate(where), np.concatenate(top)

    def train(self, texts: list[bytes], label: np.ndarray, epochs: int = EPOCHS, seed: int = 0) -> Model:
        """Adam on the cross entropy, both labels weighted to half the mass, by all chunks of each text."""
        rng = np.random.default_rng(seed)
        data = [chunks(t) for t in texts]
        n_pos = max(1.0, float(label.sum()))
        weight = np.where(label == 1, 0.5 * len(label) / n_pos, 0.5 * len(label) / max(1.0, len(label) - n_pos))
        weight = np.sqrt(weight)
        params = [self.tables, self.bias, self.out]
        m, v, t_step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for epoch in range(epochs):
            rate = RATE * (1 - 0.9 * epoch / max(1, epochs - 1))
            order = rng.permutation(len(data))
            for lo in range(0, len(order), BATCH):
                rows = order[lo : lo + BATCH]
                own = [data[i] for i in rows]
                sizes = np.array([len(c) for c in own])
                at, doc_of = np.cumsum(sizes) - sizes, np.repeat(np.arange(len(own)), sizes)
                x = np.concatenate(own)
                where, top = self.peaks(x)
                top = top + self.bias
                lit = top > 0
                top = np.maximum(top, 0)
                mean, peak = np.add.reduceat(top, at) / sizes[:, None], np.maximum.reduceat(top, at)
                doc = np.concatenate([mean, peak], axis=1)
                p = 1 / (1 + np.exp(-np.clip(doc @ self.out[:-1] + self.out[-1], -30, 30)))
                err = ((p - label[rows]) * weight[rows] / len(rows)).astype(np.float32)
                g_doc = err[:, None] * self.out[:-1]
                g_top = (g_doc[:, :FILTERS] / sizes[:, None])[doc_of] + np.where(top == peak[doc_of], g_doc[doc_of, FILTERS:], 0)
                g_top *= lit
                grads = [np.zeros_like(self.tables), g_top.sum(axis=0), np.append(err @ doc, err.sum()).astype(np.float32)]
                filters = np.broadcast_to(np.arange(FILTERS), where.shape)
                for j in range(WIDTH):
                    byte = np.take_along_axis(x, where * STRIDE + j, axis=1)
                    flat = byte.astype(np.int64) * FILTERS + filters
                    grads[0][j] = np.bincount(flat.ravel(), g_top.ravel(), 256 * FILTERS).reshape(256, FILTERS)
                t_step += 1
                for i, (p_, g) in enumerate(zip(params, grads)):
                    m[i] += 0.1 * (g - m[i])
                    v[i] += 0.001 * (g * g - v[i])
                    p_ -= (rate * (m[i] / (1 - 0.9**t_step) / (np.sqrt(v[i] / (1 - 0.999**t_step)) + 1e-8) + DECAY * p_)).astype(np.float32)
        return self


def learn(docs: DataFrame, labels: DataFrame, size: int = SAMPLE_DOCS) -> Model:
    """Train on about ``size`` labelled rows outside the held-out fold, whole texts, in the driver.

    Where these would be more than ``SAMPLE_BYTES`` bytes, fewer rows are taken, by the same hash of their ids.
    """
    chosen = sample(docs, labels, "quality", 3, 1, size)
    total = chosen.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if total > SAMPLE_BYTES:
        chosen = sample(docs, labels, "quality", 3, 1, max(1, int(size * SAMPLE_BYTES / total)))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    rows = chosen.select(raw, F.col("label").cast("int").alias("label")).toArrow().to_pylist()
    rows.sort(key=lambda r: (r["label"], r["text"]))
    return Model().train([r["text"] for r in rows], np.array([r["label"] for r in rows], np.float32)) if rows else Model()


def rate(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    A null or empty text is read as one chunk of zero bytes; a text of any length is read whole, in bounded
    blocks of chunks. A document with both labels counts as label 1. A null doc_id is in no fold: held_out is
    false. Without labelled rows the untrained network answers. Repeated rows are rated alike; other
    columns are ignored.
    """
    model = learn(docs, labels)

    def run(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 512):
                part = b.slice(lo, 512)
                s = model.probabilities([t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    marked = spread(docs.select("doc_id", "text")).withColumn("held_out", F.coalesce(id_bucket("doc_id", 3) == 1, F.lit(False)))
    return marked.mapInArrow(run, marked.drop("text").schema.add("score", "double").add("predicted", "integer"))
