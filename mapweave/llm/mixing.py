"""Mixing sources to target weights.

The words of each source, its documents one after another in hash order, are cut into blocks of ``block_words``. The
mix is a list of slots in shards; how many slots of each source a shard gets is drawn multinomially (without
replacement from the slots that each source has left in its group of shards, so the totals hold). A source's k-th slot
takes the block at a pseudorandom permutation's place k, pass after pass, and blocks are joined by index. The last
slot of a source is cut to its target, so a source's taken words are its rounded target.

Null and empty texts have no words and are never taken; a null source is a source; repeated rows are documents of
their own; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import WORD, cells, materialize, numbered

_WORDS = re.compile(WORD)
BLOCK_WORDS = 64
SHARD_SLOTS = 1024
#: Shards whose counts are drawn together; the sum of their slots is far below what numpy's sampler can take.
GROUP_SHARDS = 64
MAX_SHARE = 2.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: np.ndarray, weights: np.ndarray, total: float, most: float = MAX_SHARE) -> np.ndarray:
    """Shares ``total`` by weight; no share above ``most`` times its size, the excess shared again by weight.

    If every source is at its limit, the rest of ``total`` is not placed.
    """
    limit = most * sizes.astype(np.float64)
    target = np.zeros(len(sizes))
    open_ = limit > 0
    left = float(total)
    while open_.any() and left > 0:
        share = np.where(open_, weights, 0.0) / weights[open_].sum() * left
        over = open_ & (share > limit)
        if not over.any():
            return np.where(open_, share, target)
        target[over] = limit[over]
        left -= limit[over].sum()
        open_ &= ~over
    return target


def permuted(k: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Places of ``k`` (0 <= k < n) under a pseudorandom permutation of range(n): a Feistel network, walked until in range."""
    half = max(1, (int(n - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng([seed, n]).integers(0, 1 << 63, size=4, dtype=np.uint64)

    def once(x):
        left, right = x >> np.uint64(half), x & mask
        for key in keys:
            f = (right + key) * np.uint64(0x9E3779B97F4A7C15)
            f ^= f >> np.uint64(29)
            f *= np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((f >> np.uint64(32)) & mask)
        return (left << np.uint64(half)) | right

    out = once(k.astype(np.uint64))
    far = out >= n
    while far.any():
        out[far] = once(out[far])
        far = out >= n
    return out.astype(np.int64)


def slots_of(words: int, target: int, block: int) -> int:
    """Slots that make ``target`` words of a source of ``words`` words; a whole pass has ceil(words / block) slots."""
    if words == 0:
        return 0
    passes, rest = divmod(target, words)
    return passes * -(-words // block) + -(-rest // block)


def _shard_slots(sources: list[tuple[int, int, int]], block: int, shard_slots: int, seed: int):
    """A function of group numbers that yields the slots of each group's shards."""
    words = np.array([w for _, w, _ in sources], dtype=np.int64)
    targets = [t for _, _, t in sources]
    slots = [slots_of(int(w), t, block) for w, t in zip(words, targets, strict=True)]
    groups = max(1, -(-sum(slots) // (shard_slots * GROUP_SHARDS)))

    def blocks(s: int, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pass, block and words taken of the source's slots k."""
        w, whole = int(words[s]), int(words[s]) // block
        per_pass = -(-w // block)
        turn, inside = np.divmod(k, per_pass)
        place = inside.copy()
        full = inside < whole  # the short block at the end keeps its place
        for t in np.unique(turn[full]):
            here = full & (turn == t)
            place[here] = permuted(inside[here], whole, seed * 1_000_003 + sources[s][0] * 101 + int(t))
        take = np.minimum(block, w - place * block)
        last = k == slots[s] - 1
        passes, rest = divmod(targets[s], w)
        if rest:
            take[last] = np.minimum(take[last], rest - (-(-rest // block) - 1) * block)
        return turn, place, take

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for g in frame["id"]:
                low = np.array([n * int(g) // groups for n in slots], dtype=object)
                high = np.array([n * (int(g) + 1) // groups for n in slots], dtype=object)
                left = (high - low).astype(np.int64)
                shards = max(1, -(-int(left.sum()) // shard_slots))
                rng = np.random.default_rng([seed, int(g)])
                at = low.astype(np.int64)
                for shard in range(shards):
                    n = min(shard_slots, int(left.sum()))
                    counts = rng.multivariate_hypergeometric(left, n) if n else np.zeros_like(left)
                    parts = []
                    for s in np.flatnonzero(counts):
                        k = at[s] + np.arange(counts[s])
                        turn, place, take = blocks(s, k)
                        parts.append(pd.DataFrame({"source_no": np.int32(sources[s][0]), "turn": turn, "block": place, "take": take}))
                    at, left = at + counts, left - counts
                    if parts:
                        out = pd.concat(parts, ignore_index=True).iloc[rng.permutation(n)]
                        out.insert(0, "slot", np.arange(n, dtype=np.int64))
                        out.insert(0, "shard", np.int64(int(g) * GROUP_SHARDS + shard))
                        yield out.reset_index(drop=True)

    return draw, groups


def mix(
    docs: DataFrame, key: str, source: str, size: Column, weight_of: Callable[[list], list[float]], share: float = 1.5,
    block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = 17, carry: dict[str, Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """The mix of ``docs`` and its sizes.

    First frame, one row per taken piece: shard, slot, turn (pass of the source), row_no (of the document's row), ``key``, start, length (words of
    the document) and at (the piece's first word in its slot). Second frame, one row per document: row_no, ``key``,
    size, source_size, target, and the columns of ``carry``. ``weight_of`` gets the source names by code point, null last, and gives their weights. Only
    one row per source comes to the driver.
    """
    more = [c.alias(name) for name, c in (carry or {}).items()]
    sized = materialize(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), size.alias("size"), *more))
    rows = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    rows.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = np.array([r["size"] or 0 for r in rows], dtype=np.int64)
    weights = np.array(weight_of([r["source"] for r in rows]), dtype=np.float64)
    targets = water_fill(sizes, weights, share * float(sizes.sum())) if rows else np.zeros(0)
    spark = docs.sparkSession
    table = spark.createDataFrame(
        [(i, r["source"], int(sizes[i]), float(targets[i])) for i, r in enumerate(rows)],
        "source_no int, source string, source_size long, target double",
    )
    # one row per source, a table of a size that is known here
    named = sized.alias("d").join(F.broadcast(table).alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
    n_rows = sum(r["n"] for r in rows)
    keyed = named.select("key", "size", "source_no", "source_size", "target", *(carry or {}),
                         cells(F.col("key"), max(64, math.isqrt(n_rows))).alias("cell"))
    placed = materialize(
        numbered(keyed, ["source_no"], ["key", "size"], "size", "cell")
        .withColumn("row_no", F.monotonically_increasing_id())
    )
    per_block = F.lit(block_words)
    pieces = placed.where("size > 0").withColumn(
        "block", F.explode(F.sequence(F.floor(F.col("before") / per_block), F.floor((F.col("before") + F.col("size") - 1) / per_block)))
    ).select(
        "source_no", "block", "key", "row_no",
        F.greatest(F.lit(0), F.col("block") * per_block - F.col("before")).alias("start"),
        F.least(F.col("size"), (F.col("block") + 1) * per_block - F.col("before")).alias("stop"),
        F.greatest(F.lit(0), F.col("before") - F.col("block") * per_block).alias("at"),
    )
    draw, groups = _shard_slots([(i, int(sizes[i]), round(float(targets[i]))) for i in range(len(rows))], block_words, shard_slots, seed)
    slots = spark.range(0, groups, 1, min(groups, 4096)).mapInPandas(draw, "shard long, slot long, source_no int, turn long, block long, take long")
    length = F.least(F.col("stop") - F.col("start"), F.col("take") - F.col("at"))
    # Spark takes the slots for as few rows as the groups they are drawn from; both sides grow with the corpus
    taken = slots.join(pieces.hint("merge"), ["source_no", "block"]).select(
        "shard", "slot", "turn", "row_no", F.col("key").alias(key), "start", length.alias("length"), "at",
    ).where("length > 0")
    return taken, placed.select("row_no", F.col("key").alias(key), "size", "source_size", "target", *(carry or {}))


def repeating_weights(names: list, pattern: tuple[float, ...] = (3.0, 1.0, 2.0)) -> list[float]:
    return [pattern[i % len(pattern)] for i in range(len(names))]


def _cut(texts: pd.Series, ranges: pd.Series) -> pd.Series:
    """The words of each range (first word, number of words), neighbours joined, with what is between them in the text."""
    out = []
    for text, found in zip(texts, ranges, strict=True):
        spans = [m.span() for m in _WORDS.finditer(text)]
        runs: list[list[int]] = []
        for r in found:
            if runs and runs[-1][1] == r["start"]:
                runs[-1][1] += r["length"]
            else:
                runs.append([r["start"], r["start"] + r["length"]])
        if len(runs) == 1 and runs[0] == [0, len(spans)]:
            out.append(text)
        else:
            out.append(" ".join(text[spans[a][0]: spans[b - 1][1]] for a, b in runs))
    return pd.Series(out)


def mixed_texts(docs: DataFrame, key: str, source: str, text: str, weight_of: Callable[[list], list[float]], **options) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes words of it, with those words in ``text`` and the
    document's other columns."""
    carry = {"_source": F.col(source), "_hash": F.xxhash64(text)}
    taken, rows = mix(docs, key, source, word_count(F.col(text)), weight_of, carry=carry, **options)
    ranges = taken.groupBy("row_no", "turn").agg(F.sort_array(F.collect_list(F.struct("start", "length"))).alias("_ranges"))
    ranges = ranges.join(rows.select("row_no", F.col(key).alias("_key"), *carry), "row_no").drop("row_no", "turn")
    hashed = docs.withColumn("_text_hash", F.xxhash64(text)).dropDuplicates([key, source, "_text_hash"])
    joined = hashed.join(ranges, hashed[key].eqNullSafe(ranges["_key"]) & (F.col("_text_hash") == F.col("_hash"))
                         & hashed[source].eqNullSafe(ranges["_source"]))
    cut = F.pandas_udf(_cut, "string")
    return joined.withColumn(text, cut(F.col(text), F.col("_ranges"))).select(*docs.columns)
