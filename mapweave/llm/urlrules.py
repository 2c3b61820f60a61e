"""URL filtering by a bit-parallel wildcard automaton.

All glob rules are packed into one multiword Shift-And automaton: a bit per pattern position, ``*`` and ``**`` as
positions that loop on themselves. The canonical urls of an Arrow batch run through it together, a byte position
at a time, so every rule is simulated on every url at once. Of the rules that accept, the longest wins.

A rule is a host and a path prefix (``example.net/en/``: that host and its subdomains, paths that begin so) or a glob
over ``.host/path`` (``*`` stops at ``/``, ``**`` doesn't, ``?`` is one byte). A null url, or one without ``://``, has an
empty host and path and is judged by the default. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALLOW, BLOCK = "allow", "block"


@dataclass(frozen=True)
class Rule:
    verdict: str
    text: str  # host/path, or a glob if ``glob``
    glob: bool = False

    def pattern(self) -> str:
        return self.text if self.glob else f"*.{self.text}**"


def _after_scheme(url: Column) -> Column:
    return F.substr(url, F.locate("://", url) + 3)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or url."""
    host = F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


class Automaton:
    """Shift-And over many globs. ``run`` gives for each text the number of the first pattern, in order, that accepts."""

    def __init__(self, patterns: list[str]):
        tokens: list[tuple[int, str]] = []  # (pattern number, one symbol) of every position
        self.last = []
        for number, pattern in enumerate(patterns):
            at = 0
            while at < len(pattern):
                symbol = "**" if pattern.startswith("**", at) else pattern[at]
                at += len(symbol)
                if symbol in ("*", "**", "?") or ord(symbol) < 128:
                    tokens.append((number, symbol))
                else:
                    tokens += [(number, chr(b)) for b in symbol.encode()]
            self.last.append(len(tokens))
            tokens.append((number, ""))  # the state after the whole pattern
        self.words = -(-len(tokens) // 64) if tokens else 0
        step = np.zeros((256, self.words * 64), dtype=bool)  # from position p on this byte to p + 1
        loop = np.zeros((256, self.words * 64), dtype=bool)
        skip = np.zeros(self.words * 64, dtype=bool)  # a wildcard may take nothing
        start = np.zeros(self.words * 64, dtype=bool)
        for p, (number, symbol) in enumerate(tokens):
            if p == 0 or tokens[p - 1][0] != number:
                start[p] = True
            if symbol == "**":
                loop[:, p], skip[p] = True, True
            elif symbol == "*":
                loop[:, p], skip[p] = True, True
                loop[ord("/"), p] = False
            elif symbol == "?":
                step[:, p] = True
            elif symbol:
                step[ord(symbol), p] = True
        self.step, self.loop = self._packed(step), self._packed(loop)
        self.skip = self._packed(skip[None])[0]
        self.deepest = max((len(p) for p in patterns), default=0)
        self.start = self._closed(self._packed(start[None]))
        self.accept = np.array(self.last, dtype=np.int64)

    @staticmethod
    def _packed(bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)

    @staticmethod
    def _shifted(state: np.ndarray) -> np.ndarray:
        """Every bit one place up, across words."""
        out = state << np.uint64(1)
        out[:, 1:] |= state[:, :-1] >> np.uint64(63)
        return out

    def _closed(self, state: np.ndarray) -> np.ndarray:
        """Adds what wildcards reach without taking a byte."""
        for _ in range(self.deepest):
            more = state | self._shifted(state & self.skip)
            if np.array_equal(more, state):
                break
            state = more
        return state

    def run(self, texts: list[bytes]) -> np.ndarray:
        found = np.full(len(texts), -1, dtype=np.int64)
        if not self.words or not texts:
            return found
        sizes = np.array([len(t) for t in texts])
        order = np.argsort(-sizes, kind="stable")  # urls that have ended are at the end
        raw = np.frombuffer(b"".join(texts[i] for i in order), dtype=np.uint8)
        sizes = sizes[order]
        begins = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        state = np.repeat(self.start, len(texts), axis=0)
        for at in range(int(sizes[0])):
            n = int(np.searchsorted(-sizes, -at, side="left"))  # urls longer than ``at``
            byte = raw[begins[:n] + at]
            now = state[:n]
            state[:n] = self._closed(self._shifted(now & self.step[byte]) | (now & self.loop[byte]))
        for number in range(len(self.accept) - 1, -1, -1):
            word, bit = divmod(int(self.accept[number]), 64)
            hit = (state[:, word] >> np.uint64(bit)) & np.uint64(1) == 1
            found[order[hit]] = number
        return found


def judge(pages: DataFrame, key: str, url: str, rules: list[Rule], default: str = ALLOW, batch: int = 4096) -> DataFrame:
    """``key``, host, path, rule (null without one) and verdict of every row.

    Longer rules come first; among rules as long, the one given first.
    """
    ranked = sorted(rules, key=lambda r: -len(r.text.encode()))
    automaton = Automaton([r.pattern() for r in ranked])
    found = F.locate("://", F.col("_url")) > 0
    parts = pages.select(F.col(key).alias("key"), F.col(url).alias("_url")).select(
        "key",
        F.when(found, host_of(F.col("_url"))).otherwise("").alias("host"),
        F.when(found, path_of(F.col("_url"))).otherwise("").alias("path"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = [f".{h or ''}{p or ''}".encode() for h, p in zip(part["host"].to_pylist(), part["path"].to_pylist(), strict=True)]
                hits = automaton.run(texts)
                yield pa.record_batch(
                    [part["key"], part["host"], part["path"],
                     pa.array([ranked[i].text if i >= 0 else None for i in hits], pa.string()),
                     pa.array([ranked[i].verdict if i >= 0 else default for i in hits], pa.string())],
                    names=["key", "host", "path", "rule", "verdict"])

    kind = pages.schema[key].dataType.simpleString()
    return parts.mapInArrow(run, f"key {kind}, host string, path string, rule string, verdict string").withColumnRenamed("key", key)
