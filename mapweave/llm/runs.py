"""Periodic runs of words: recursive frequency splitting, then a lag scan.

A run is a stretch of consecutive words with smallest period q, at least ``exponent`` periods and ``least`` words long, that
no neighbouring word extends keeping that period. Every word of a run occurs at least ``exponent`` times in it. So in any
segment of a text a word that occurs less often can't be in a run that lies in the segment: such words split it, the parts are
counted by themselves, and so on until no part changes. Most texts are gone by then. What survives is scanned lag by lag:
a run of period q holds ``exponent - 1`` whole blocks that begin at multiples of q, all equal, so a lag costs m / q block
comparisons (m log m for all lags of a segment) and only lags with such blocks are compared word by word.

Words are maximal runs of other than space and ``\\t \\n \\v \\f \\r``, compared exactly, numbered from 0 in their text.

A null or empty text has no words and no runs. Rows are judged one by one: repeated rows and repeated or null keys are rows of
their own, ties of words don't arise, columns besides key and text are not read, an empty table gives no rows. A long text is
worked on by itself, with memory in proportion to its length.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.llm.common import let, slices

EXPONENT, LEAST = 4, 6
_BASE = 0x9E3779B97F4A7C13
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def split_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts in order, and for each text where its words begin (one more entry at the end)."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    words, at = lists.values, lists.offsets.to_numpy()
    full = pc.greater(pc.binary_length(words), 0)
    before = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(full.to_numpy(zero_copy_only=False), out=before[1:])
    return words.filter(full), before[at]


def segments(codes: np.ndarray, at: np.ndarray, exponent: int, least: int) -> list[tuple[int, int]]:
    """Begin and end of the parts in which every word occurs ``exponent`` times or more and that have ``least`` words.

    A part that stays as it is in a round is settled; only the others are counted again.
    """
    if len(codes) == 0:
        return []
    width, settled = int(codes.max()) + 1, []
    place = np.arange(len(codes))
    part = np.repeat(np.arange(len(at) - 1), np.diff(at))
    while len(place):
        _, entry, counts = np.unique(part * width + codes[place], return_inverse=True, return_counts=True)
        often = counts[entry] >= exponent
        whole = np.ones(int(part[-1]) + 1, dtype=bool)
        whole[part[~often]] = False
        done = whole[part]
        settled += _stretches(place[done], part[done], least)
        place, part = place[often & ~done], part[often & ~done]
        if len(place):
            begins = np.ones(len(place), dtype=bool)
            begins[1:] = (np.diff(place) > 1) | (part[1:] != part[:-1])
            part = np.cumsum(begins) - 1
            long = np.bincount(part)[part] >= least
            place, part = place[long], part[long]
    return sorted(settled)


def _stretches(place: np.ndarray, part: np.ndarray, least: int) -> list[tuple[int, int]]:
    if not len(place):
        return []
    firsts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
    sizes = np.diff(np.append(firsts, len(place)))
    return [(int(place[i]), int(place[i] + n)) for i, n in zip(firsts, sizes, strict=True) if n >= least]


def _repeats(mask: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last index of every stretch of True."""
    hits = np.flatnonzero(mask)
    cuts = np.flatnonzero(np.diff(hits) > 1)
    yield from zip(hits[np.append(0, cuts + 1)].tolist(), hits[np.append(cuts, len(hits) - 1)].tolist(), strict=True)


def lag_scan(words: np.ndarray, exponent: int, least: int) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of one segment, in order of period and start."""
    m = len(words)
    up = np.full(m, _BASE, dtype=np.uint64)
    down = np.full(m, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
    up[:1] = down[:1] = 1
    up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
    value = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    value ^= value >> np.uint64(29)
    sums = np.zeros(m + 1, dtype=np.uint64)
    np.cumsum(value * up, out=sums[1:])
    found: dict[int, tuple[list[int], list[int]]] = {}
    for q in range(1, m // exponent + 1):
        blocks = m // q
        hashes = np.diff(sums[: blocks * q + 1: q]) * down[: blocks * q: q]
        same = hashes[1:] == hashes[:-1]
        for _ in range(exponent - 3):
            same = same[1:] & same[:-1]
        if not same.any():
            continue
        starts, ends = [], []
        # of a stretch with a smaller period p that divides q, the run of period p has been found, and it is the same stretch
        inner = [found[p] for p in found if q % p == 0]
        for first, last in _repeats(same):
            low, high = first * q, (last + exponent - 1) * q
            if any((i := bisect_right(s, low)) and e[i - 1] >= low + (exponent - 1) * q for s, e in inner):
                continue
            for low, high in _exact(words, q, low, high, (exponent - 1) * q):
                # a whole further block would have been a hit: less than q words are left on either side
                left = words[max(0, low - q): low] == words[max(0, low - q) + q: low + q]
                right = words[high: high + q] == words[high - q: min(high, m - q)]
                start = low - int(np.argmin(np.append(left[::-1], False)))
                end = high + int(np.argmin(np.append(right, False)))
                if end - start >= max(least, exponent * q) and (not starts or start > starts[-1]):
                    starts.append(start)
                    ends.append(end)
        if starts:
            found[q] = (starts, ends)
    return [(s, e - s, q) for q, (starts, ends) in found.items() for s, e in zip(starts, ends, strict=True)]


def _exact(words: np.ndarray, q: int, low: int, high: int, size: int) -> list[tuple[int, int]]:
    """The stretches inside [low, high) that do have period q, if hashes of other blocks were equal by chance."""
    same = words[low: high - q] == words[low + q: high]
    if same.all():
        return [(low, high)]
    return [(low + a, low + b + 1 + q) for a, b in _repeats(same) if b + 1 - a + q >= size] if same.any() else []


def runs_of_batch(codes: np.ndarray, at: np.ndarray, exponent: int = EXPONENT, least: int = LEAST):
    """Arrays (text, start, length, period), by text, start and period."""
    rows = []
    for low, high in segments(codes, at, exponent, least):
        text = int(np.searchsorted(at, low, side="right")) - 1
        rows += [(text, low + s - int(at[text]), n, q) for s, n, q in lag_scan(codes[low:high], exponent, least)]
    found = np.array(sorted(rows, key=lambda r: (r[0], r[1], r[3])), dtype=np.int64).reshape(-1, 4)
    return found.T


def kept_words(at: np.ndarray, text: np.ndarray, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Which words stay: not those that a run has after its first period."""
    change = np.zeros(int(at[-1]) + 1, dtype=np.int64)
    np.add.at(change, at[text] + start + period, 1)
    np.add.at(change, at[text] + start + length, -1)
    return np.cumsum(change)[:-1] == 0


def _analysed(batch: pa.RecordBatch, exponent: int, least: int) -> pa.RecordBatch:
    words, at = split_words(batch.column("text"))
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text, start, length, period = runs_of_batch(codes, at, exponent, least)
    keep = kept_words(at, text, start, length, period)
    kept_at = np.zeros(len(words) + 1, dtype=np.int64)
    np.cumsum(keep, out=kept_at[1:])
    kept = pa.LargeListArray.from_arrays(pa.array(kept_at[at]), words.filter(pa.array(keep)))
    per_text = np.zeros(len(at), dtype=np.int32)
    np.cumsum(np.bincount(text, minlength=len(at) - 1), out=per_text[1:])
    runs = pa.ListArray.from_arrays(pa.array(per_text), pa.StructArray.from_arrays(
        [pa.array(start), pa.array(length), pa.array(period)], fields=list(_RUN)))
    return pa.record_batch([batch.column("key"), pa.array(np.diff(at)), runs, pc.binary_join(kept, " ").cast(pa.string())],
                           names=["key", "n_words", "runs", "collapsed"])


def periodic_runs(df: DataFrame, key: str, text: str | Column, exponent: int = EXPONENT, least: int = LEAST) -> DataFrame:
    """(key, n_words, runs, collapsed) of every row: its runs by start and period, and its words joined by single spaces
    without those that a run has after its first period. ``exponent`` is 3 or more."""
    if exponent < 3:
        raise ValueError("runs of less than three periods are not looked for")

    def analyse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                yield _analysed(batch.slice(a, b - a), exponent, least)

    text = F.col(text) if isinstance(text, str) else text
    run = T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")])
    schema = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])
    return df.select(F.col(key).alias("key"), text.alias("text")).mapInArrow(analyse, schema)


def with_planted_runs(key: Column, text: Column) -> Column:
    """Of a tenth of all texts (by a checksum of the key) the words from some place on repeat with some period; the others as they are."""
    check = F.crc32(key.cast("string").cast("binary"))
    seed = F.floor(check / 10)

    def planted(words: Column) -> Column:
        n = F.size(words)
        first = (seed % n).cast("int")
        period = F.lit(1) + F.floor((n - first) / (3 + seed % 8)).cast("int")
        moved = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(words, F.when(i >= first, first + (i - first) % period).otherwise(i)))
        return F.when(n > 0, F.array_join(moved, " ")).otherwise(text)

    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.when(check % 10 == 0, let(words, planted)).otherwise(text)


def digests(runs: DataFrame, key: str) -> DataFrame:
    """Counts, the longest run and checksums of a table of ``periodic_runs``."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    wide = runs.withColumn("best", longest)
    return wide.select(
        F.col("key").alias(key), F.size("runs").cast("long").alias("n_runs"), (-F.col("best.s")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).cast("long").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
