"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into blocks of 8. A block's inputs are the
learned embeddings of its bytes and one channel of self-similarity, the share
of its bytes that equal the byte a fixed distance before, at the best distance
up to 24 (it makes repeated words visible to a linear filter). Filters span
chunks of 4 blocks, 32 bytes, and step by one block, so chunks overlap and
cover the whole document. Rectified responses are max-pooled over all chunks,
and a small dense layer combines them into one probability.

Filters over chunks of blocks are one matrix product per batch: the product
of every block with the weights of each of the 4 positions, shifted and added.

Training uses a bounded labelled sample in the driver; the weights have a
fixed size. Rows: null and empty texts are scored as chunks of padding;
repeated rows get equal scores; without labels every score is 0.5; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, functions as F

from assetloom.llm.arrow import map_chunks, utf8
from assetloom.llm.labelled import fold, labelled_sample

FOLDS, HELD_OUT = 4, 2
SAMPLE = 3_000
CUT = 0.7
BLOCK, SPAN, EMBED, FILTERS, HIDDEN = 8, 4, 8, 32, 16
LAGS = 24
INPUTS = BLOCK * EMBED + 1
EPOCHS, BATCH, RATE = 12, 32, 3e-3
#: Characters of the passages that fill up a small sample, at least.
CROP = 100
#: Bytes of the texts that are scored at once.
SCORE_BYTES = 1 << 20

_ONES = np.uint64(0x0101010101010101)


def blocks_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts in blocks, each text behind ``SPAN - 1`` blocks of zeros, and where each begins.

    Zeros also close the last text, so no chunk holds bytes of two texts.
    """
    gap = (SPAN - 1) * BLOCK
    parts, starts, at = [], [], 0
    for text in texts:
        size = -(-max(len(text), 1) // BLOCK) * BLOCK
        parts += [bytes(gap), text, bytes(size - len(text))]
        starts.append(at // BLOCK)
        at += gap + size
    parts.append(bytes(gap))
    return np.frombuffer(b"".join(parts), np.uint8).reshape(-1, BLOCK), np.array(starts)


def self_match(blocks: np.ndarray) -> np.ndarray:
    """Share of each block's bytes that equal the byte one distance before, at the best distance."""
    flat = blocks.reshape(-1)
    best = np.zeros(len(blocks), np.uint64)
    same = np.zeros(flat.shape, np.uint8)
    live = flat != 0
    for lag in range(1, LAGS + 1):
        np.equal(flat[lag:], flat[:-lag], out=same[lag:].view(bool))
        same[lag:] &= live[lag:].view(np.uint8)
        np.maximum(best, (same.view(np.uint64) * _ONES) >> np.uint64(56), out=best)
    return best.astype(np.float32) / BLOCK


class ByteCnn:
    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {
            "embed": normal(256, EMBED, scale=0.5), "filters": normal(SPAN, INPUTS, FILTERS, scale=(SPAN * INPUTS) ** -0.5),
            "shift": np.zeros(FILTERS, np.float32), "dense": normal(FILTERS, HIDDEN, scale=FILTERS**-0.5),
            "dense_shift": np.zeros(HIDDEN, np.float32), "out": normal(HIDDEN, scale=HIDDEN**-0.5), "out_shift": np.zeros(1, np.float32),
        }
        self.p["embed"][0] = 0

    def inputs(self, blocks: np.ndarray, match: np.ndarray) -> np.ndarray:
        x = np.empty((len(blocks), INPUTS), np.float32)
        x[:, :-1] = self.p["embed"][blocks.reshape(-1)].reshape(len(blocks), -1)
        x[:, -1] = match
        return x

    def responses(self, x: np.ndarray) -> np.ndarray:
        """Filter responses of every chunk of ``SPAN`` blocks."""
        each = x @ self.p["filters"].transpose(1, 0, 2).reshape(INPUTS, -1)
        n = len(x) - SPAN + 1
        total = each[:n, :FILTERS].copy()
        for i in range(1, SPAN):
            total += each[i : i + n, i * FILTERS : (i + 1) * FILTERS]
        return total

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled @ self.p["dense"] + self.p["dense_shift"], 0)
        z = hidden @ self.p["out"] + self.p["out_shift"][0]
        return hidden, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """Probabilities of texts; a text of any length counts with all of its chunks."""
        out, at = np.empty(len(texts)), 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= SCORE_BYTES):
                size += len(texts[end])
                end += 1
            blocks, starts = blocks_of(texts[at:end])
            match = self_match(blocks)
            if end == at + 1 and len(blocks) > 4 * SCORE_BYTES // BLOCK:
                pooled = self._long(blocks, match)
            else:
                response = self.responses(self.inputs(blocks, match))
                pooled = np.maximum.reduceat(response, starts, axis=0)
            out[at:end] = self.head(np.maximum(pooled + self.p["shift"], 0))[1]
            at = end
        return out

    def _long(self, blocks: np.ndarray, match: np.ndarray) -> np.ndarray:
        best = np.full((1, FILTERS), -np.inf, np.float32)
        step = SCORE_BYTES // BLOCK
        for s in range(0, len(blocks) - SPAN + 1, step):
            part = slice(s, s + step + SPAN - 1)
            best = np.maximum(best, self.responses(self.inputs(blocks[part], match[part])).max(axis=0))
        return best

    def gradients(self, blocks: np.ndarray, starts: np.ndarray, match: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the weighted log loss; the pooled maxima carry them to single chunks."""
        x = self.inputs(blocks, match)
        response = self.responses(x)
        ends = np.append(starts[1:], len(response))
        top = np.stack([s + response[s:e].argmax(axis=0) for s, e in zip(starts, ends)])
        raw = np.take_along_axis(response, top, axis=0) + self.p["shift"]
        pooled = np.maximum(raw, 0)
        hidden, p = self.head(pooled)
        dz = ((p - y) * weight / len(y)).astype(np.float32)
        dh = np.outer(dz, self.p["out"]) * (hidden > 0)
        dp = (dh @ self.p["dense"].T) * (raw > 0)
        g = {"out": hidden.T @ dz, "out_shift": dz.sum(keepdims=True), "dense": pooled.T @ dh, "dense_shift": dh.sum(axis=0), "shift": dp.sum(axis=0)}
        g["filters"], g["embed"] = np.zeros_like(self.p["filters"]), np.zeros_like(self.p["embed"])
        for i in range(SPAN):
            at = top + i
            g["filters"][i] = np.einsum("bfi,bf->if", x[at], dp)
            dx = np.einsum("bf,if->bfi", dp, self.p["filters"][i])[:, :, :-1].reshape(-1, EMBED)
            np.add.at(g["embed"], blocks[at].reshape(-1), dx)
        g["embed"][0] = 0
        return g

    def train(self, texts: list[bytes], labels: list[int], epochs: int = EPOCHS, seed: int = 11) -> None:
        """Adam over shuffled batches; the classes weigh in by the root of their odds."""
        rng = np.random.default_rng(seed)
        y = np.array(labels, float)
        share = np.clip(y.mean(), 0.02, 0.98)
        weight = np.where(y > 0, 1.0, math.sqrt(share / (1 - share)))
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, total = 0, epochs * -(-len(texts) // BATCH)
        for _ in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                blocks, starts = blocks_of([texts[i] for i in rows])
                g = self.gradients(blocks, starts, self_match(blocks), y[rows], weight[rows])
                step += 1
                rate = RATE * min(1.0, 1.2 - step / total)
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)


def with_crops(texts: list[str], labels: list[int], seed: int = 5) -> tuple[list[str], list[int]]:
    """A small sample with random passages of its texts added, up to ``SAMPLE`` texts or 8 for each."""
    rng = np.random.default_rng(seed)
    more, more_labels = list(texts), list(labels)
    for text, label in zip(texts, labels):
        for _ in range(min(8, SAMPLE // len(texts) - 1) if len(text) >= 2 * CROP else 0):
            size = int(rng.integers(CROP, 3 * len(text) // 4 + 1))
            start = int(rng.integers(0, len(text) - size + 1))
            more.append(text[start : start + size])
            more_labels.append(label)
    return more, more_labels


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS) -> ByteCnn | None:
    """A trained network, or none if the sample lacks a class."""
    if len(set(labels)) < 2:
        return None
    texts, labels = with_crops(texts, labels)
    model = ByteCnn()
    # small samples take more passes, so that the steps are enough
    model.train([t.encode() for t in texts], labels, epochs=max(epochs, min(60, 12_000 // len(texts))))
    return model


def _scorer(model: ByteCnn | None):
    def make():
        def step(batch):
            texts = utf8(batch.column("text"))
            return {"doc_id": batch.column("doc_id"), "score": model.scores(texts) if model else np.full(len(texts), 0.5)}

        return step

    return make


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Return ``doc_id, held_out, score, predicted`` for every row of ``docs(doc_id, text)``.

    ``sample`` bounds the labelled rows that train; rows of the held-out fold
    never do.
    """
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fit(*labelled_sample(given, labels, "quality", FOLDS, HELD_OUT, sample))
    scored = map_chunks(given, _scorer(model), "doc_id long, score double")
    held_out = (fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
