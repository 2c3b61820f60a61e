"""Toxicity scores by a convolutional text classifier.

A word (a run of letters or bytes above 127, A-Z lower-cased) is the sum of the vectors of its hash and of the hashes of
its first four and five bytes. Filters of widths 1 to 3 slide over the words of the whole text, the largest response of
each filter goes into a logistic layer. All labelled rows teach: Spark counts the buckets of both labels, shards of rows are
trained beside each other (numpy, Adagrad; only where a filter is largest does a word get a gradient) and their changes are
averaged, round by round. On every sixth row, which training leaves out, a threshold is chosen for each language and moved
to 0.5. The language of a text is guessed from its own frequent words, never from a column.

Texts without words, null ones included, get the score of a text of padding. Without labels of both kinds every score is
0. Repeated rows get equal scores; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import broadcast_model, slices
from mapweave.llm.shingles import hash_words
from mapweave.session import materialize_bucketed, recorded, remove_tables

BUCKETS, DIM, FILTERS, WIDTHS = 1 << 18, 12, 8, (1, 2, 3)
SHARD_ROWS = 3000  # labelled rows that are trained on one after the other; more rows are more shards
EPOCHS = (3, 2)  # passes over a shard in each round; after a round the shards' changes are averaged
FILTER_BITS = 1 << 26  # 8 MB; tells labelled keys from most others
HELD = 6  # every sixth row calibrates
STEP = 1 << 24  # changes are summed in whole steps of 1 / STEP, so that sums depend on no order
LOGIT_BINS = 256  # bins of a logit's unit that thresholds are told apart by
CHUNK_WORDS = 1 << 16
CAUTION = 1.5  # standard errors that a bucket's first weight is held back by
#: Frequent words that tell the four languages apart, for the choice of a threshold only.
FREQUENT = {
    "en": ("the", "and", "of", "to", "in", "is", "that", "was", "for", "with"),
    "de": ("der", "die", "und", "von", "den", "zu", "im", "ein", "des", "mit"),
    "fr": ("le", "la", "et", "les", "de", "un", "en", "pas", "sur", "avec"),
    "es": ("el", "que", "y", "los", "del", "las", "por", "una", "su", "para"),
}
LANGUAGES = ("other", *FREQUENT)

_LETTERS = [b for b in range(256) if not (65 <= b <= 90 or 97 <= b <= 122 or b >= 128)]


def _features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of every word, (words, 3), and where each text's words begin."""
    hashes, at = hash_words(texts, separators=_LETTERS, prefixes=(4, 5))
    return np.stack([(h >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1) for h in hashes], axis=1), at


def _language_table() -> np.ndarray:
    table = np.zeros(BUCKETS, dtype=np.int64)
    for number, name in enumerate(FREQUENT, 1):
        found, _ = _features(pa.array([" ".join(FREQUENT[name])]))
        table[found[:, 0]] = number
    return table


def _guess(words: np.ndarray, at: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Number of the language whose frequent words are most; 0 without any."""
    kinds = table[words[:, 0]] if len(words) else np.zeros(0, dtype=np.int64)
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    votes = np.bincount(text * len(LANGUAGES) + kinds, minlength=(len(at) - 1) * len(LANGUAGES)).reshape(-1, len(LANGUAGES))
    votes[:, 0] = 0
    return votes.argmax(axis=1)


@dataclass
class Model:
    vectors: np.ndarray  # (BUCKETS + 1, DIM); the last is padding, zero
    filters: list[np.ndarray]  # per width (width, DIM, FILTERS)
    layer: np.ndarray
    bias: float
    shift: np.ndarray = field(default_factory=lambda: np.zeros(len(LANGUAGES)))
    scale: float = 1.0

    def responses(self, words: np.ndarray, at: np.ndarray, where: bool = False):
        """Largest response of every filter in every text, and if asked the word where it is."""
        n = len(at) - 1
        best = np.full((n, FILTERS * len(WIDTHS)), -np.inf, dtype=np.float32)
        places = np.zeros(best.shape, dtype=np.int64)
        reach = max(WIDTHS) - 1
        gap = reach + 1  # padding after a text; one of it stands for a text without words
        # texts are cut into parts of bounded length; a part also sees the words after it, up to its text's end
        for i0, i1 in _parts(at):
            low, high = int(max(at[i0], i1[0])), int(min(at[i1[2]], i1[1]))
            texts = np.arange(i0, i1[2])
            begins = np.clip(at[i0:i1[2]], low, high)
            ends = np.clip(at[i0 + 1:i1[2] + 1], low, high)
            lone = len(texts) == 1
            after = int(min(at[i1[2]], high + reach)) if lone else high
            sizes = ends - begins
            # every text's words followed by padding (or by its own next words)
            new = begins - low + np.arange(len(texts)) * gap
            rows = np.full((int(sizes.sum()) + gap * len(texts), words.shape[1]), BUCKETS, dtype=np.int64)
            if lone:
                rows[: after - low] = words[low:after]
            else:
                target = np.arange(low, high) - low + np.repeat(np.arange(len(texts)), sizes) * gap
                rows[target] = words[low:high]
            x = self.vectors[rows].sum(axis=1)
            sizes = np.maximum(sizes, 1)  # a text without words is one of padding
            edges = np.empty(2 * len(texts), dtype=np.int64)
            edges[::2], edges[1::2] = new, np.minimum(new + sizes, len(rows) - reach)
            for k, width in enumerate(WIDTHS):
                m = len(x) - width + 1
                z = x[:m] @ self.filters[k][0]
                for j in range(1, width):
                    z += x[j: j + m] @ self.filters[k][j]
                cut = edges if edges[-1] < m else edges[:-1]
                top = np.maximum.reduceat(z, cut, axis=0)[::2]
                here = slice(k * FILTERS, (k + 1) * FILTERS)
                best[texts, here] = np.maximum(best[texts, here], top)
                if where:
                    for t in range(len(texts)):
                        part = z[new[t]: new[t] + sizes[t]]
                        places[texts[t], here] = part.argmax(axis=0) + new[t]
            if where:
                return best, places, rows
        return best

    def strongest(self, words: np.ndarray):
        """``responses`` with places of one text of any length: the winning words of every filter are all that is kept of its parts."""
        reach = max(WIDTHS) - 1
        best = np.full((1, FILTERS * len(WIDTHS)), -np.inf, dtype=np.float32)
        windows = np.full((best.shape[1], reach + 1, words.shape[1]), BUCKETS, dtype=np.int64)
        for low in range(0, max(1, len(words) - reach), CHUNK_WORDS - reach):
            part = words[low: low + CHUNK_WORDS]
            found, places, rows = self.responses(part, np.array([0, len(part)]), where=True)
            better = np.flatnonzero(found[0] > best[0])
            best[0, better] = found[0, better]
            windows[better] = rows[np.minimum(places[0, better][:, None] + np.arange(reach + 1), len(rows) - 1)]
        return best, (np.arange(best.shape[1]) * (reach + 1))[None, :], windows.reshape(-1, words.shape[1])

    def logits(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        if len(at) < 2:
            return np.zeros(0)
        return np.maximum(self.responses(words, at), 0).astype(np.float64) @ self.layer + self.bias

    def scores(self, texts: pa.Array, table: np.ndarray) -> np.ndarray:
        words, at = _features(texts)
        z = (self.logits(words, at) - self.shift[_guess(words, at, table)]) * self.scale
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def _parts(at: np.ndarray) -> Iterator[tuple[int, tuple[int, int, int]]]:
    """Runs of texts of at most CHUNK_WORDS words together, and pieces of texts that are longer: first text, (first word, last word, text after)."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + CHUNK_WORDS, side="right")) - 1)
        j = min(j, n)
        if j == i + 1:
            low, end = int(at[i]), int(at[j])
            while True:
                high = min(end, low + CHUNK_WORDS)
                yield i, (low, high, j)
                low = high
                if low >= end:
                    break
        else:
            yield i, (int(at[i]), int(at[j]), j)
        i = j


def _untrained(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS + 1, DIM)).astype(np.float32)
    vectors[BUCKETS] = 0
    return Model(vectors, [rng.normal(0, 0.3, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS],
                 rng.normal(0, 0.3, FILTERS * len(WIDTHS)), 0.0)


def _start(seen: np.ndarray, rows: tuple[int, int], seed: int) -> Model:
    """A model whose first filter begins as a detector: each bucket's log-odds between the labels, less its standard errors.

    ``seen`` has the rows of label 0 and of label 1 that hold each bucket, ``rows`` all of them."""
    model = _untrained(seed)
    one, none = seen[1] + 0.5, seen[0] + 0.5
    odds = np.log(one / (rows[1] + 1)) - np.log(none / (rows[0] + 1))
    sure = np.maximum(np.abs(odds) - CAUTION * np.sqrt(1 / one + 1 / none), 0) * np.sign(odds)
    sure[BUCKETS] = 0
    model.vectors[:, 0] = sure
    model.filters[0][0, :, 0] = 0
    model.filters[0][0, 0, 0] = 1
    model.layer[0] = 1
    return model


def _seen(made: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    seen = np.zeros((2, BUCKETS + 1), dtype=np.int64)
    for words, y in zip(made, labels, strict=True):
        seen[int(y)][np.unique(words)] += 1
    return seen


def _made(texts: list[str | None]) -> list[np.ndarray]:
    return [_features(pa.array([t or ""], pa.string()))[0].astype(np.int32) for t in texts]


def _train(model: Model, made: list[np.ndarray], labels: np.ndarray, rows: tuple[int, int], epochs: int, rng: np.random.Generator,
           rate: float = 0.1, batch: int = 16) -> None:
    """Passes over ``made`` that change ``model``. ``rows``: rows of label 0 and 1 in all shards, which weigh the labels."""
    past = {"v": np.full(model.vectors.shape, 1e-3, dtype=np.float32), "l": np.full(model.layer.shape, 1e-2), "b": 1e-2,
            "f": [np.full(f.shape, 1e-2, dtype=np.float32) for f in model.filters]}
    weight = np.clip(np.where(labels == 1, rows[0] / max(1, rows[1]) if rows[0] else 1.0, 1.0), 1.0, 10.0)
    for _ in range(epochs):
        shuffled = rng.permutation(len(made))
        for b in range(0, len(shuffled), batch):
            pick, group, room = shuffled[b: b + batch], [], 0
            groups = []
            for i in pick:  # a step sees at most CHUNK_WORDS words at once, a longer text alone
                if group and room + len(made[i]) > CHUNK_WORDS:
                    groups.append(group)
                    group, room = [], 0
                group.append(i)
                room += len(made[i])
            groups.append(group)
            for group in groups:
                parts = [made[i] for i in group]
                at = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
                if at[-1] > CHUNK_WORDS:  # one long text
                    best, places, padded = model.strongest(parts[0])
                else:
                    best, places, padded = model.responses(np.concatenate(parts), at, where=True)
                act = np.maximum(best, 0)
                z = act @ model.layer + model.bias
                y = labels[group]
                error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight[group] / len(group)
                back = (error[:, None] * model.layer) * (best > 0)
                g = act.T @ error
                past["l"] += g**2
                model.layer -= rate * g / np.sqrt(past["l"])
                past["b"] += error.sum() ** 2
                model.bias -= rate * error.sum() / np.sqrt(past["b"])
                touched, changes = [], []
                for k, width in enumerate(WIDTHS):
                    f = model.filters[k]
                    gf = np.zeros_like(f)
                    t, c = np.nonzero(back[:, k * FILTERS: (k + 1) * FILTERS])
                    amount = back[t, k * FILTERS + c].astype(np.float32)
                    place = places[t, k * FILTERS + c]
                    for j in range(width):
                        rows_j = padded[place + j]
                        x = model.vectors[rows_j].sum(axis=1)
                        np.add.at(gf[j].T, c, amount[:, None] * x)
                        gv = amount[:, None] * f[j].T[c]
                        for column in range(rows_j.shape[1]):
                            touched.append(rows_j[:, column])
                            changes.append(gv)
                    past["f"][k] += gf**2
                    f -= rate * gf / np.sqrt(past["f"][k])
                if touched:
                    ids, inverse = np.unique(np.concatenate(touched), return_inverse=True)
                    total = np.zeros((len(ids), DIM), dtype=np.float32)
                    np.add.at(total, inverse, np.concatenate(changes))
                    total[ids == BUCKETS] = 0
                    past["v"][ids] += total**2
                    model.vectors[ids] -= rate * total / np.sqrt(past["v"][ids])


def fit(rows: list[tuple[str | None, int]], seed: int = 3) -> Model | None:
    """A model of rows (text, 0 or 1) in one shard, or None unless both labels occur. Every sixth row calibrates."""
    labels = np.array([int(y) for _, y in rows])
    if len(set(labels.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held = order[::HELD] if len(rows) >= 10 * HELD else order[:0]
    train = np.setdiff1d(order, held)
    made, own = _made([rows[i][0] for i in train]), labels[train]
    known = (int((own == 0).sum()), int((own == 1).sum()))
    model = _start(_seen(made, own), known, seed)
    for epochs in EPOCHS:
        _train(model, made, own, known, epochs, rng)
    if len(held):
        words, at = _features(pa.array([rows[i][0] or "" for i in held], pa.string()))
        _calibrate(model, _logit_counts(model, words, at, labels[held], _language_table()))
    return model


def _rest(model: Model) -> np.ndarray:
    """Filters, layer and bias of a model in rows of DIM."""
    rest = np.concatenate([*[f.ravel() for f in model.filters], model.layer, [model.bias]])
    return np.pad(rest, (0, -len(rest) % DIM)).reshape(-1, DIM)


def _flat(model: Model) -> np.ndarray:
    """All numbers of a model in rows of DIM: first the vectors, then filters, layer and bias."""
    return np.concatenate([model.vectors.astype(np.float64), _rest(model)])


def _changes(new: Model, old: Model) -> tuple[np.ndarray, np.ndarray]:
    """The rows of ``_flat`` that differ (those after the vectors always), and by how many whole steps. No table of all vectors is made for it."""
    moved = np.flatnonzero((new.vectors != old.vectors).any(axis=1))
    tail = _rest(new) - _rest(old)
    vectors = np.rint((new.vectors[moved].astype(np.float64) - old.vectors[moved]) * STEP).astype(np.int64)
    kept = vectors.any(axis=1)
    at = np.concatenate([moved[kept], BUCKETS + 1 + np.arange(len(tail))])
    return at, np.concatenate([vectors[kept], np.rint(tail * STEP).astype(np.int64)])


def _moved(model: Model, flat: np.ndarray) -> Model:
    """The model with the numbers of ``flat``."""
    rest, filters = flat[BUCKETS + 1:].ravel(), []
    for f in model.filters:
        filters.append(rest[: f.size].reshape(f.shape).astype(np.float32))
        rest = rest[f.size:]
    n = len(model.layer)
    return Model(flat[: BUCKETS + 1].astype(np.float32), filters, rest[:n].copy(), float(rest[n]))


def _shard(table: pa.Table) -> tuple[list[str | None], np.ndarray]:
    """Texts and labels of a shard by ascending key; of several rows of one key the largest text and label count."""
    best: dict[int, tuple[str | None, int]] = {}
    for key, text, y in zip(*[table[c].to_pylist() for c in ("key", "text", "label")], strict=True):
        known = best.get(key)
        if known is not None and (text is None or (known[0] is not None and known[0].encode() > text.encode())):
            text = known[0]
        best[key] = (text, max(y, known[1]) if known else y)
    rows = [best[k] for k in sorted(best)]
    return [t for t, _ in rows], np.array([y for _, y in rows], dtype=np.int64)


def fit_all(rows: DataFrame, shards: int, seed: int = 3) -> Model | None:
    """A model of all ``rows`` (key, text, label), which become ``shards`` parts by a hash of the key. None unless both labels occur.

    The driver gets sums of fixed size: two counts a bucket, a model a round, counts of logits by bin and language."""
    spark = rows.sparkSession
    place = F.xxhash64(F.lit(seed), "key")
    with recorded() as paths:
        saved = materialize_bucketed(rows.select("key", "text", "label", F.pmod(place, F.lit(shards)).cast("int").alias("shard")), "shard")
    try:
        n = {r[0]: r[1] for r in saved.groupBy("label").count().collect()}
        if not n.get(0) or not n.get(1):
            return None
        # a key's fold does not follow from its shard
        fold = F.pmod(F.xxhash64(F.lit(seed + 1), "key"), F.lit(HELD))
        held = saved.where(fold == 0) if n[0] + n[1] >= 10 * HELD else None
        train = saved.where(fold != 0) if held is not None else saved
        return _fit_shards(spark, train, held, seed)
    finally:
        remove_tables(spark, paths)


_COLUMNS = [f"d{i}" for i in range(DIM)]


def _learner(shared, known: tuple[int, int], epochs: int, seed: tuple[int, int]):
    """What a shard's training changes in the shared model, in whole steps, by row of ``_flat``."""

    def learn(table: pa.Table) -> pa.Table:
        texts, labels = _shard(table)
        old = shared.value
        own = Model(old.vectors.copy(), [f.copy() for f in old.filters], old.layer.copy(), old.bias)
        _train(own, _made(texts), labels, known, epochs, np.random.default_rng((*seed, table["shard"][0].as_py())))
        at, change = _changes(own, old)
        return pa.table({"bucket": pa.array(at, pa.int32()), **{c: change[:, i] for i, c in enumerate(_COLUMNS)}})

    return learn


def _fit_shards(spark, train: DataFrame, held: DataFrame | None, seed: int) -> Model:
    def count(table: pa.Table) -> pa.Table:
        texts, labels = _shard(table)
        seen = _seen(_made(texts), labels)
        seen[:, BUCKETS] = np.bincount(labels, minlength=2)[:2]  # of all rows
        at = np.flatnonzero(seen.any(axis=0))
        return pa.table({"bucket": pa.array(at, pa.int32()), "zeros": seen[0][at], "ones": seen[1][at]})

    counts = train.groupBy("shard").applyInArrow(count, "bucket int, zeros long, ones long").groupBy("bucket").agg(F.sum("zeros"), F.sum("ones"))
    seen = np.zeros((2, BUCKETS + 1), dtype=np.int64)
    at, *both = [c.to_numpy() for c in counts.toArrow().columns]
    seen[:, at] = both
    known = (int(seen[0][BUCKETS]), int(seen[1][BUCKETS]))
    seen[:, BUCKETS] = 0
    model = _start(seen, known, seed)
    for turn, epochs in enumerate(EPOCHS):
        shared = spark.sparkContext.broadcast(model)

        changes = train.groupBy("shard").applyInArrow(_learner(shared, known, epochs, (seed, turn)), "bucket int, " + ", ".join(f"{c} long" for c in _COLUMNS))
        # a bucket's change is the mean over the shards that changed it
        means = changes.groupBy("bucket").agg(*[(F.sum(c) / F.count(F.lit(1)) / STEP).cast("float").alias(c) for c in _COLUMNS]).toArrow()
        flat = _flat(model)
        flat[means["bucket"].to_numpy()] += np.stack([means[c].to_numpy() for c in _COLUMNS], axis=1)
        shared.destroy()
        model = _moved(model, flat)
    if held is not None:
        shared = spark.sparkContext.broadcast((model, _language_table()))

        def logits(table: pa.Table) -> pa.Table:
            texts, labels = _shard(table)
            words, at = _features(pa.array([t or "" for t in texts], pa.string()))
            return pa.table(_logit_counts(shared.value[0], words, at, labels, shared.value[1]))

        found = held.groupBy("shard").applyInArrow(logits, "language int, bin int, zeros long, ones long")
        found = found.groupBy("language", "bin").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones")).toArrow()
        if found.num_rows:
            _calibrate(model, {c: found[c].to_numpy() for c in found.column_names})
        shared.destroy()
    return model


def held_out(modulus: int, key: str = "doc_id") -> Column:
    """Remainder of the checksum of a key as text: the folds of labelled rows."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % modulus


def fit_labelled(docs: DataFrame, labels: DataFrame) -> Model | None:
    """A model of all rows of ``docs`` (doc_id, text) that have ``labels`` (doc_id, toxic) outside the held-out fold. Of several
    labels or texts of one doc_id the largest counts."""
    outside = held_out(5) != 0
    known = labels.select("doc_id", "toxic").where(outside & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    rows = _with_bits(docs.select("doc_id", "text").where(outside), known).join(known.hint("merge"), "doc_id")
    shards = max(1, -(-known.count() // SHARD_ROWS))
    return fit_all(rows.select(F.col("doc_id").alias("key"), "text", (F.col("toxic") > 0).cast("int").alias("label")), shards)


def _with_bits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text) whose bit some row of ``known`` has: most texts without a label are not moved. A bitmap of
    fixed size, which only saves work; the join behind it is exact."""
    parts = known.select((F.col("bit") + 1).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")).collect()
    table = np.zeros(FILTER_BITS // 8, dtype=np.uint8)
    for r in parts:  # bucket p = 1, 2, ... holds 4096 bytes
        table[(r["part"] - 1) * 4096: r["part"] * 4096] = np.frombuffer(r["bits"], dtype=np.uint8)
    shared = broadcast_model(docs.sparkSession, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch["bit"].to_numpy()
            yield batch.filter(pa.array((shared.value[bit >> 3] >> (bit & 7)) & 1 == 1)).select(["doc_id", "text"])

    rows = docs.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)))
    return rows.mapInArrow(run, docs.schema)


def _logit_counts(model: Model, words: np.ndarray, at: np.ndarray, labels: np.ndarray, table: np.ndarray) -> dict[str, np.ndarray]:
    """Rows of each label by guessed language and bin of their logit."""
    bins = np.rint(np.clip(model.logits(words, at), -60, 60) * LOGIT_BINS).astype(np.int64)
    pairs, inverse = np.unique(np.stack([_guess(words, at, table), bins]), axis=1, return_inverse=True)
    ones = np.bincount(inverse.ravel(), weights=labels, minlength=pairs.shape[1]).astype(np.int64)
    every = np.bincount(inverse.ravel(), minlength=pairs.shape[1]).astype(np.int64)
    return {"language": pairs[0].astype(np.int32), "bin": pairs[1].astype(np.int32), "zeros": every - ones, "ones": ones}


def _threshold(bins: np.ndarray, zeros: np.ndarray, ones: np.ndarray) -> float:
    """The middle of the widest range of logits with the fewest errors."""
    values, inverse = np.unique(bins, return_inverse=True)
    zeros, ones = (np.bincount(inverse, weights=w) for w in (zeros, ones))
    z = values / LOGIT_BINS
    wrong = np.concatenate([[0], np.cumsum(ones)]) + zeros.sum() - np.concatenate([[0], np.cumsum(zeros)])
    edges = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    room = np.concatenate([[1.0], np.diff(z), [1.0]])
    least_wrong = np.flatnonzero(wrong == wrong.min())
    return float(edges[least_wrong[np.argmax(room[least_wrong])]])


def _calibrate(model: Model, counts: dict[str, np.ndarray], least: int = 20) -> None:
    """Thresholds by language, of the rows that ``_logit_counts`` counted."""
    parts = [counts[c] for c in ("bin", "zeros", "ones")]
    model.shift[:] = _threshold(*parts)
    for number in range(1, len(LANGUAGES)):
        bins, zeros, ones = (p[counts["language"] == number] for p in parts)
        if zeros.sum() + ones.sum() >= least and zeros.sum() and ones.sum():
            model.shift[number] = _threshold(bins, zeros, ones)
    model.scale = 1.0


def score(docs: DataFrame, key: str, text: str, model: Model | None) -> DataFrame:
    """``key`` and score of every row."""
    shared = broadcast_model(docs.sparkSession, (model, _language_table()))
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value
        for batch in batches:
            for a, b in slices(batch["text"]):
                part = batch.slice(a, b - a)
                found = model.scores(part["text"], table) if model is not None else np.zeros(part.num_rows)
                yield pa.record_batch([part["key"], pa.array(found, pa.float64())], names=["key", "score"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep_below(docs: DataFrame, text: str, model: Model | None, threshold: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, that score below ``threshold``."""
    shared = broadcast_model(docs.sparkSession, (model, _language_table()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, table = shared.value
        for batch in batches:
            for a, b in slices(batch[text]):
                part = batch.slice(a, b - a)
                if model is not None:
                    part = part.filter(pa.array(model.scores(part[text], table) < threshold))
                yield part

    return docs.mapInArrow(run, docs.schema)
