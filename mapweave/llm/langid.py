"""Language identification: averaged hashed subword embeddings under a linear softmax.

Subwords are the 2-, 3- and 4-byte n-grams of the text's UTF-8 (A-Z lower-cased, every byte that is not part of a word
a blank, runs of blanks kept). A text is the mean of its n-grams' vectors; a linear layer and a softmax give the languages.
Trained by stochastic gradient descent in numpy; a temperature and a rejection threshold are fitted on rows that
training left out. For scoring, vectors and layer are multiplied into one table of n-gram by language.

A null text, or one without a letter, is ``und`` with score 0. Without any labelled row every text is ``und``.
Repeated rows get equal results; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import slices
from mapweave.llm.shingles import text_buffers

BUCKETS, DIM, ORDERS = 1 << 16, 16, (2, 3, 4)
PER_LANGUAGE = 1000  # bound of the sample that training sees
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = 32
_FOLD[91:97] = 32
_FOLD[123:128] = 32


def _grams(raw: np.ndarray, order: int) -> np.ndarray:
    """Bucket of the n-gram that begins at each byte (short ones at the end of the batch take blanks)."""
    folded = np.concatenate([_FOLD[raw], np.full(order - 1, 32, dtype=np.uint8)]).astype(np.uint32)
    value = np.full(len(raw), order, dtype=np.uint32)
    for k in range(order):
        value = value * np.uint32(0x01000193) ^ folded[k: k + len(raw)]
    value = value * np.uint32(0x9E3779B1)
    return (value >> np.uint32(16)).astype(np.int64) & (BUCKETS - 1)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    reject_below: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Probabilities; n-grams that begin in a text and end in the next are few and left out."""
        raw, offsets = text_buffers(texts)
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        for order in ORDERS:
            stop = np.maximum(offsets[1:] - (order - 1), offsets[:-1])  # only whole n-grams of the text
            size = stop - offsets[:-1]
            some = np.flatnonzero(size > 0)
            if not len(some):
                continue
            values = self.table[_grams(raw, order)]
            edges = np.empty(2 * len(some), dtype=np.int64)
            edges[::2], edges[1::2] = offsets[:-1][some], stop[some]
            if edges[-1] == len(values):
                edges = edges[:-1]
            total[some] += np.add.reduceat(values, edges, axis=0)[::2]
            count += size
        logits = (total / np.maximum(count, 1)[:, None] + self.bias) / self.temperature
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        return odds / odds.sum(axis=1, keepdims=True)


def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    found = [_grams(raw, order)[: max(0, len(raw) - order + 1)] for order in ORDERS]
    ids, n = np.unique(np.concatenate(found), return_counts=True)
    return ids, n / max(1, n.sum())


def fit(rows: list[tuple[str | None, str]], epochs: int = 4, rate: float = 0.5, seed: int = 5) -> Model | None:
    """A model of rows (text, language), or None without any. Every tenth row calibrates."""
    rows = [(t or "", label) for t, label in rows]
    languages = sorted({label for _, label in rows})
    if not languages:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = set(order[::10].tolist()) if len(rows) >= 50 else set()
    bags = [_bag(t) for t, _ in rows]
    labels = np.array([languages.index(label) for _, label in rows])
    vectors = rng.normal(0, 0.1, (BUCKETS, DIM))
    layer = rng.normal(0, 0.1, (DIM, len(languages)))
    bias = np.zeros(len(languages))
    scale = 20.0  # means of many vectors are short
    train = [i for i in range(len(rows)) if i not in held]
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(train):
            ids, weight = bags[i]
            mean = scale * (weight @ vectors[ids])
            logits = mean @ layer + bias
            odds = np.exp(logits - logits.max())
            error = odds / odds.sum()
            error[labels[i]] -= 1
            back = layer @ error
            layer -= step * 0.1 * np.outer(mean, error)
            bias -= step * 0.1 * error
            vectors[ids] -= step * scale * weight[:, None] * back
    model = Model(languages, (scale * vectors @ layer).astype(np.float32), bias, 1.0, 0.0)
    if held:
        at = sorted(held)
        logits = np.log(np.maximum(model.scores(pa.array([rows[i][0] for i in at])), 1e-300))
        right = labels[at]

        def loss(t):
            z = logits / t
            z = z - z.max(axis=1, keepdims=True)
            return -(z[np.arange(len(at)), right] - np.log(np.exp(z).sum(axis=1))).mean()

        model.temperature = float(min(np.geomspace(0.2, 20, 60), key=loss))
        p = model.scores(pa.array([rows[i][0] for i in at]))
        good = p.max(axis=1)[p.argmax(axis=1) == right]
        model.reject_below = float(np.quantile(good, 0.01)) if len(good) else 0.0
    return model


def identify(docs: DataFrame, key: str, text: str, model: Model | None) -> DataFrame:
    """``key``, lang_pred, score (of that language) and rejected (score below the calibrated threshold)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False)).alias("letters"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                known = part["letters"].to_numpy(zero_copy_only=False)
                best, score, names = np.zeros(len(known), dtype=int), np.zeros(len(known)), [UNKNOWN] * len(known)
                if model is not None and known.any():
                    p = model.scores(part["text"])
                    best = p.argmax(axis=1)
                    score = np.where(known, p[np.arange(len(p)), best], 0.0)
                    names = [model.languages[i] if k else UNKNOWN for i, k in zip(best, known, strict=True)]
                bar = model.reject_below if model is not None else 1.0
                yield pa.record_batch([part["key"], pa.array(names, pa.string()), pa.array(score), pa.array(~known | (score < bar))],
                                      names=["key", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"key {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("key", key)
