"""Packing token sequences into windows of fixed length by non-negative least squares.

Every document's full windows stand alone. What remains (shorter than a window) is counted by length, in units of
``unit`` tokens. All combinations of at most ``depth`` lengths that fill a window exactly are enumerated; non-negative
least squares gives how often to use each, against the histogram; counts are rounded down, and what is left over is
packed greedily by length, cutting an item where a gap of at least ``min_cut`` units stays. The plan is made from the
histogram alone, so its size does not depend on the number of documents; documents then look up their places by their
number within their length.

Null and empty texts are one piece with only the end token; repeated rows are packed each on its own; an empty table
gives no pieces. Windows are padded to their length.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.llm.common import cells, materialize, numbered, slices
from mapweave.llm.shingles import text_buffers

WINDOW, UNIT, DEPTH, MIN_CUT, END = 2048, 8, 3, 4, 1

#: White space as the tokenizer's pattern sees it (the Unicode property, without the separators U+001C to U+001F).
_WS = "\t-\r \x85\xa0" + "".join(f"{chr(a)}-{chr(b)}" for a, b in (
    (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)))
#: Cuts a text only where the tokenizer's own pattern cuts it, too: pieces can be encoded one by one.
_COARSE = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")


class _Known:
    """Ids of pieces of text, as packed integers; those seen last are kept. When full, they become the older half; pieces that are
    met again come back from there. New words are encoded ``together``, a line each."""

    def __init__(self, encode, dtype, most=150_000):
        self.encode, self.dtype, self.most, self.seen, self.older = encode, dtype, most, {}, {}
        self.line = encode("\n")

    def __call__(self, pieces: list[bytes], together: bool) -> list[bytes]:
        found = list(map(self.seen.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        unknown = []
        for i in new:
            found[i] = self.older.get(pieces[i])
            if found[i] is None:
                unknown.append(i)
        words = [i for i in unknown if not _BLANK[pieces[i][-1]]] if together and len(self.line) == 1 else []
        if words:
            # a line break between words is a token of its own, and in no word
            ids = np.asarray(self.encode(b"\n".join([pieces[i] for i in words]).decode()), dtype=self.dtype)
            cuts = np.flatnonzero(ids == self.line[0])
            packed, width = ids.tobytes(), self.dtype.itemsize
            for i, low, high in zip(words, [0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(packed)], strict=True):
                found[i] = packed[low:high]
        for i in unknown:
            if found[i] is None:
                found[i] = np.asarray(self.encode(pieces[i].decode()), dtype=self.dtype).tobytes()
        if len(self.seen) >= self.most:
            self.older, self.seen = self.seen, {}
        self.seen.update((pieces[i], found[i]) for i in new if len(pieces[i]) < 64)
        return found


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[*range(0x09, 0x0E), 0x20]] = True


def _pieces(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of texts without white space beyond ASCII begin: the cuts of ``_COARSE``. The last blank before a word
    begins a piece, which a space shares with the word; the blanks before it are one piece, and so are those at a text's end."""
    blank = _BLANK[raw]
    begins = np.zeros(len(raw) + 1, dtype=bool)
    begins[offsets] = True
    inside = ~begins[1:-1]  # a byte with another of its text before it
    words = np.flatnonzero(inside & blank[:-1] & ~blank[1:]) + 1
    begins[1:-1] |= inside & ~blank[:-1] & blank[1:]
    begins[words - 1] = True
    begins[words[raw[words - 1] != 0x20]] = True
    return np.flatnonzero(begins[:-1])


def _wide_blanks(raw: np.ndarray) -> np.ndarray:
    """Places of white space beyond ASCII."""
    lead = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)))
    lead = lead[lead + 1 < len(raw)]
    second = raw[lead + 1]
    third = raw[np.minimum(lead + 2, len(raw) - 1)]
    first = raw[lead]
    general = (first == 0xE2) & (second == 0x80) & (((third >= 0x80) & (third <= 0x8A)) | (third == 0xA8) | (third == 0xA9) | (third == 0xAF))
    found = ((first == 0xC2) & ((second == 0x85) | (second == 0xA0)) | (first == 0xE1) & (second == 0x9A) & (third == 0x80) | general
             | (first == 0xE2) & (second == 0x81) & (third == 0x9F) | (first == 0xE3) & (second == 0x80) & (third == 0x80))
    return lead[found]


@lru_cache(maxsize=2)
def encoder(vocabulary: str, ranks: str | None):
    """A function of an array of texts to the packed ids (uint16 or uint32) of each, of a byte-level BPE vocabulary.

    A batch is cut into pieces (``_COARSE``) by its bytes, each different piece is encoded once, and the texts' ids are gathered
    from those. Texts with white space beyond ASCII or with a special token are encoded one by one.

    ``vocabulary`` is a tokenizers file by its name in the folder of public tokenizers or by its path; ``ranks`` the same
    vocabulary as merge ranks, which encode single words faster.
    """
    import base64
    import json

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    place = lambda name: name if "/" in name else public_tokenizers.path(name)
    with open(place(vocabulary), encoding="utf-8") as file:
        parts = json.load(file)
    special = [t["content"] for t in parts["added_tokens"]]
    size = 1 + max([*parts["model"]["vocab"].values(), *(t["id"] for t in parts["added_tokens"])])
    dtype = np.dtype("<u2") if size <= 1 << 16 else np.dtype("<u4")
    del parts
    loaded: list[Tokenizer] = []  # only where a text needs it: it takes much memory

    def whole(text: str) -> list[int]:
        if not loaded:
            loaded.append(Tokenizer.from_file(place(vocabulary)))
        return loaded[0].encode(text, add_special_tokens=False).ids

    if ranks:
        with open(place(ranks), "rb") as file:
            merges = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file)}
        words = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})
        encode = words.encode_ordinary
    else:
        encode = whole
    known = _Known(encode, dtype)

    def alone(text: str) -> bytes:
        if any(x in text for x in special):
            return np.asarray(whole(text), dtype=dtype).tobytes()
        return b"".join(known([x.encode() for x in _COARSE.findall(text)], False))

    def packed(texts: pa.Array) -> list[bytes]:
        raw, offsets = text_buffers(texts)
        other = np.zeros(len(texts), dtype=bool)
        other[np.searchsorted(offsets, _wide_blanks(raw), side="right") - 1] = True
        for x in special:
            other |= pc.match_substring(texts, x).fill_null(False).to_numpy(zero_copy_only=False)
        if other.any():
            raw, offsets = text_buffers(pc.if_else(pa.array(other), "", texts))
        starts = _pieces(raw, offsets)
        pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(np.append(starts, len(raw)).astype(np.int64)), pa.py_buffer(raw)])
        pieces = pieces.dictionary_encode()
        ids = known(pieces.dictionary.to_pylist(), True)
        lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // dtype.itemsize
        flat, begins = np.frombuffer(b"".join(ids), dtype=dtype), np.cumsum(lengths) - lengths
        entry = pieces.indices.to_numpy()
        ends = np.concatenate(([0], np.cumsum(lengths[entry])))
        gathered = flat[np.arange(ends[-1]) + np.repeat(begins[entry] - ends[:-1], lengths[entry])]
        at = ends[np.searchsorted(starts, offsets)]
        found = [gathered[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        for i in np.flatnonzero(other).tolist():
            found[i] = alone(texts[i].as_py() or "")
        return found

    return packed, dtype


def tokenized(docs: DataFrame, key: str, text: str, vocabulary: str, ranks: str | None, end: int = END) -> DataFrame:
    """Columns ``key``, tokens (their number), wide (4 bytes an id, else 2) and ids (packed, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, dtype = encoder(vocabulary, ranks)
        last = np.asarray([end], dtype=dtype).tobytes()
        for batch in batches:
            for a, b in slices(batch.column("text"), 4 << 20):
                part = batch.slice(a, b - a)
                ids = [x + last for x in packed(part.column("text"))]
                yield pa.record_batch(
                    [part.column("key"), pa.array([len(x) // dtype.itemsize for x in ids], pa.int64()),
                     pa.array([dtype.itemsize == 4] * len(ids)), pa.array(ids, pa.binary())],
                    names=["key", "tokens", "wide", "ids"])

    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {docs.schema[key].dataType.simpleString()}, tokens long, wide boolean, ids binary")


@lru_cache(maxsize=4)
def combinations(units: int, depth: int) -> tuple[tuple[int, ...], ...]:
    """All ways to fill ``units`` with at most ``depth`` lengths, longest first."""

    def fill(left: int, most: int, parts: int):
        if left == 0:
            yield ()
        elif parts:
            for n in range(min(left, most), 0, -1):
                if n * parts < left:
                    break
                for rest in fill(left - n, n, parts - 1):
                    yield (n, *rest)

    return tuple(fill(units, units, depth))


def solve_nnls(columns: np.ndarray, goal: np.ndarray, rounds: int = 600) -> np.ndarray:
    """min |columns @ x - goal| with x >= 0, by the active-set method of Lawson and Hanson."""
    x = np.zeros(columns.shape[1])
    passive: list[int] = []
    barred = np.zeros(len(x), dtype=bool)  # in use, or gave nothing when tried last
    slack = 1e-7 * max(1e-12, float(np.abs(goal).max(initial=0)))
    for _ in range(rounds):
        gain = columns.T @ (goal - columns @ x)
        gain[barred] = -np.inf
        best = int(np.argmax(gain))
        if gain[best] <= slack:
            break
        passive.append(best)
        barred[best] = True
        while passive:
            part = columns[:, passive]
            gram = part.T @ part
            gram.flat[:: len(passive) + 1] += 1e-9
            s = np.linalg.solve(gram, part.T @ goal)
            down = np.flatnonzero(s <= 0)
            if not len(down):
                x[passive] = s
                break
            now = x[passive]
            ratio = now[down] / (now[down] - s[down] + 1e-300)
            first = down[int(np.argmin(ratio))]
            x[passive] = np.maximum(now + ratio.min() * (s - now), 0.0)
            gone = passive.pop(int(first))
            x[gone] = 0.0
            if gone != best:
                barred[gone] = False
    return x


class _Pools:
    """Items still to place, by length: runs of numbers of documents of one length, and where in them the item begins."""

    def __init__(self, counts: dict[int, int]):
        self.runs = defaultdict(list)
        self.left: dict[int, int] = {}
        for n, count in counts.items():
            self.add(n, n, 0, 0, count)

    def add(self, length: int, origin: int, start: int, low: int, high: int) -> None:
        if high > low:
            self.runs[length].append((origin, start, low, high))
            self.left[length] = self.left.get(length, 0) + high - low

    def draw(self, length: int, n: int) -> list[tuple[int, int, int, int]]:
        out = []
        self.left[length] -= n
        if not self.left[length]:
            del self.left[length]
        while n:
            origin, start, low, high = self.runs[length].pop()
            take = min(n, high - low)
            out.append((origin, start, low, low + take))
            if low + take < high:
                self.runs[length].append((origin, start, low + take, high))
            n -= take
        return out


def plan(counts: dict[int, int], units: int, depth: int = DEPTH, min_cut: int = MIN_CUT) -> tuple[list[tuple], int]:
    """Places for all items: rows (origin, low, high, start, length, sequence, slot), and the number of sequences.

    Documents numbered ``low`` to ``high`` of length ``origin`` put their units from ``start`` on into the sequences from
    ``sequence`` on, one each, at place ``slot``.
    """
    pools, rows, sequences = _Pools(counts), [], 0

    def place(items: list[tuple[int, int]], n: int) -> None:
        """Puts ``n`` of each item (length to draw, units of it to use) into ``n`` new sequences."""
        nonlocal sequences
        for slot, (length, use) in enumerate(items):
            at = sequences
            for origin, start, low, high in pools.draw(length, n):
                rows.append((origin, low, high, start, use, at, slot))
                if use < length:
                    pools.add(length - use, origin, start + use, low, high)
                at += high - low
        sequences += n

    total = sum(counts.values())
    if total:
        ways = combinations(units, depth)
        columns = np.zeros((units, len(ways)))
        for j, way in enumerate(ways):
            for n in way:
                columns[n - 1, j] += 1
        goal = np.array([counts.get(n, 0) for n in range(1, units + 1)]) / total
        times = solve_nnls(columns, goal) * total
        for j in np.argsort(-times, kind="stable"):
            if times[j] < 1:
                break
            need: dict[int, int] = defaultdict(int)
            for n in ways[j]:
                need[n] += 1
            most = min(pools.left.get(n, 0) // k for n, k in need.items())
            if most := min(int(times[j]), most):
                place([(n, n) for n in ways[j]], most)
    while pools.left:
        lengths = sorted(pools.left, reverse=True)
        used: dict[int, int] = defaultdict(int)
        items, gap = [], units
        for n in lengths:
            while n <= gap and used[n] < pools.left[n]:
                items.append((n, n))
                used[n] += 1
                gap -= n
        if gap >= min_cut:
            rest = [n for n in lengths if n > gap and used[n] < pools.left[n]]
            if rest:
                items.append((rest[0], gap))
                used[rest[0]] += 1
        place(items, min(pools.left[n] // k for n, k in used.items() if k))
    return rows, sequences


def pack(
    docs: DataFrame, key: str, text: str, vocabulary: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken",
    window: int = WINDOW, unit: int = UNIT, depth: int = DEPTH, end: int = END,
) -> DataFrame:
    """One row per piece: ``key``, start, length, ids (unsigned 32-bit, little-endian), doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    tokens = materialize(tokenized(docs, key, text, vocabulary, ranks, end).withColumn("row_no", F.monotonically_increasing_id()))
    per = F.lit(window)
    lengths = tokens.select(
        "row_no", "tokens", F.floor(F.col("tokens") / per).alias("whole"),
        F.ceil((F.col("tokens") % per) / unit).cast("int").alias("units"),
    )
    histogram = {r["units"]: (r["n"], r["whole"]) for r in lengths.groupBy("units").agg(  # at most window / unit + 1 rows
        F.count(F.lit(1)).alias("n"), F.sum("whole").alias("whole")).collect()}
    n_rows = sum(n for n, _ in histogram.values())
    rows, planned = plan({u: n for u, (n, _) in histogram.items() if u}, window // unit, depth)
    # a plan's rows depend on the number of lengths, not of documents
    places = spark.createDataFrame(rows, "units int, low long, high long, first int, used int, sequence long, slot int")
    celled = lengths.withColumn("cell", cells(F.col("row_no"), max(64, math.isqrt(n_rows))))
    ranked = numbered(celled.where("units > 0").drop("whole"), ["units"], ["row_no"], None, "cell")
    rests = ranked.join(F.broadcast(places), "units").where("before >= low AND before < high").select(
        "row_no",
        (F.col("tokens") - F.col("tokens") % per + F.col("first") * unit).alias("start"),
        F.least(F.col("used") * F.lit(unit), F.col("tokens") % per - F.col("first") * unit).cast("long").alias("length"),
        (F.col("sequence") + F.col("before") - F.col("low")).alias("sequence_id"), "slot",
    )
    wholes = numbered(celled.where("whole > 0"), [], ["row_no"], "whole", "cell").select(
        "row_no", "before", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("i")
    ).select("row_no", (F.col("i") * per).alias("start"), per.cast("long").alias("length"),
             (F.col("before") + F.col("i") + planned).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    from pyspark.sql import Window

    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    rests = rests.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")
    cuts = rests.unionByName(wholes).groupBy("row_no").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    kind = tokens.schema["key"].dataType.simpleString()
    joined = tokens.join(cuts, "row_no").select("key", "tokens", "wide", "ids", "cuts")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, out, size = [], [], 0
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(3)[i].as_py(), dtype="<u4" if batch.column(2)[i].as_py() else "<u2")
                for c in batch.column(4)[i].as_py():
                    part = ids[c["start"]: c["start"] + c["length"]].astype("<u4").tobytes()
                    keys.append(i)
                    out.append((c["start"], c["length"], part, len(ids), c["sequence_id"], c["offset"]))
                    size += len(part)
                if out and (size >= 4 << 20 or i == batch.num_rows - 1):
                    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
                    columns = [pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)]
                    yield pa.record_batch([batch.column(0).take(pa.array(keys)), *columns],
                                          names=["key", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])
                    keys, out, size = [], [], 0

    schema = f"key {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return joined.mapInArrow(cut, schema).withColumnRenamed("key", key)
