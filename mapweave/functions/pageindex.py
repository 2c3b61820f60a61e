"""Structural index of HTML pages: one pass over the bytes of a batch finds its markup, array arithmetic does the rest.

A scan marks every comment, declaration and tag (quotes in attributes and the raw content of scripts, styles, titles and the like are
passed over, as nothing in them is markup). Tags become arrays of places, names and directions. Where a page's tags nest, their
levels are prefix sums and an element ends where its level is next left; only the tags of other pages go through a stack, which
adds the ends that are missing. Elements to remove are byte intervals; what is kept of a page, and its text, are the bytes outside
of them. ``read`` gives any of these parts from the same index, so a query that needs several reads each page once.

Rules: attributes are read as a browser does (first of a name wins; names in any case; quotes of either kind or none). End tags
without a start are ignored, an end tag closes what is open inside, a paragraph or list item ends where the next begins, what is
open at the end ends there. Text nodes are trimmed, empty ones dropped. A null page reads as an empty one.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from mapweave.functions import words

#: The parts that can be read, with their types.
PARTS = {
    "clean_html": "string", "text": "string", "whole_text": "string", "title": "string", "description": "string",
    "json_ld": "array<string>", "open_graph": "map<string,string>", "twitter_card": "map<string,string>",
    "paragraphs": "int", "container": "boolean",
}

# Between pages stands the byte FF, which is in no UTF-8 text: nothing matches across it.
_ATTRIBUTES = rb"""(?>(?:=\s*(?:"[^"\xff]*"|'[^'\xff]*')|[^>\xff])*)"""
_RAW = rb"script|style|title|textarea|iframe|xmp|noembed|noframes"
_MARKUP = re.compile(
    rb"(?i)<(?:!--(?:-?>|[^\xff]*?(?:-->|(?=\xff)))"  # comment
    rb"|(" + _RAW + rb")(?=[\s/>])(" + _ATTRIBUTES + rb")>[^\xff]*?(?=</\1[\s/>]|\xff)"  # element of raw content
    rb"|(/?[a-z][^\s/>\xff]*)(" + _ATTRIBUTES + rb")>"  # tag
    rb"|[!?/][^>\xff]*>?|[a-z][^>\xff]*(?:>|(?=\xff)))"  # declaration, or a tag whose quotes never close
)
_ATTRIBUTE = re.compile(rb"""([^\s"'>/=][^\s>/=]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_VOID = frozenset(b"area base br col embed hr img input link meta param source track wbr".split())
_SPACES = "\\t\\n\\x0b\\f\\r \\x1c-\\x1f\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
_SLICE = 4 << 20


class PageIndex:
    """Markup of a batch of pages. ``start``/``end``: bytes of each tag or comment; ``name``: a number for the tag's name (0:
    none); ``kind``: 1 start, -1 end, 0 neither (comments, void and self-closed elements); ``page``; ``attrs``: bytes."""

    def __init__(self, pages: list[bytes]):
        sizes = np.array([len(p) + 1 for p in pages], dtype=np.int64)
        self.raw = b"\xff".join([*pages, b""])
        self.bytes = np.frombuffer(self.raw, dtype=np.uint8)
        self.page_end = np.cumsum(sizes) - 1
        self.page_start = self.page_end - sizes + 1
        self.names: dict[bytes, int] = {b"": 0}
        start, end, name, kind, self.attrs = [], [], [], [], []
        for m in _MARKUP.finditer(self.raw):
            group, tag, attrs, sign, stop = m.lastindex, b"", b"", 0, m.end()
            if group == 2:
                tag, attrs, sign, stop = m.group(1).lower(), m.group(2), 1, m.end(2) + 1
            elif group == 4:
                tag, attrs = m.group(3).lower(), m.group(4)
                sign = 1
                if tag[:1] == b"/":
                    tag, sign = tag[1:], -1
            if tag in _VOID or (sign > 0 and attrs[-1:] == b"/" and b"=" not in attrs[-2:-1]):
                sign = 0
            start.append(m.start())
            end.append(stop)
            kind.append(sign)
            name.append(self.names.setdefault(tag, len(self.names)))
            self.attrs.append(attrs)
        self.start, self.end = np.array(start, dtype=np.int64), np.array(end, dtype=np.int64)
        self.name, self.kind = np.array(name, dtype=np.int64), np.array(kind, dtype=np.int64)
        self.page = np.searchsorted(self.page_end, self.start)

    def tagged(self, *tags: str) -> np.ndarray:
        """Whether each piece of markup is a start (or void element) of these names."""
        codes = [self.names[t.encode()] for t in tags if t.encode() in self.names]
        return np.isin(self.name, codes) & (self.kind >= 0) & (self.name > 0)

    def element_ends(self) -> np.ndarray:
        """For each start tag the byte behind its element (for others that of the tag)."""
        stop = self.end.copy()
        tags = np.flatnonzero(self.kind)
        page, kind, name = self.page[tags], self.kind[tags], self.name[tags]
        total = np.concatenate(([0], np.cumsum(kind)))
        first = np.searchsorted(page, np.arange(len(self.page_end)))
        level = total[1:] - total[first[page]] + (kind < 0)
        nested = np.bincount(page, weights=kind, minlength=len(first)) == 0
        np.logical_and.at(nested, page, level > 0)
        inside = np.flatnonzero(nested[page])
        order = inside[np.lexsort((inside, level[inside], page[inside]))]
        opens, closes = order[0::2], order[1::2]
        np.logical_and.at(nested, page[opens], name[opens] == name[closes])
        good = nested[page[opens]]
        stop[tags[opens[good]]] = self.end[tags[closes[good]]]
        self._close(tags[~nested[page]], stop)
        return stop

    def _close(self, tags: np.ndarray, stop: np.ndarray) -> None:
        """Ends of the elements of pages whose tags don't nest."""
        sequels = {self.names.get(b"p"), self.names.get(b"li")}
        stack: list[tuple[int, int]] = []
        at = -1
        for i, page, kind, name in zip(tags.tolist(), self.page[tags].tolist(), self.kind[tags].tolist(), self.name[tags].tolist(), strict=True):
            if page != at:
                self._end(stack, stop, at)
                stack, at = [], page
            if kind > 0:
                if stack and name in sequels and stack[-1][1] == name:
                    stop[stack.pop()[0]] = self.start[i]
                stack.append((i, name))
            elif any(n == name for _, n in stack):
                while stack[-1][1] != name:
                    stop[stack.pop()[0]] = self.start[i]
                stop[stack.pop()[0]] = self.end[i]
        self._end(stack, stop, at)

    def _end(self, stack: list[tuple[int, int]], stop: np.ndarray, page: int) -> None:
        for i, _ in stack:
            stop[i] = self.page_end[page]

    def removed(self) -> np.ndarray:
        """Which bytes are in scripts, styles, frames, navigation blocks and advertising."""
        gone = self.tagged(*words.REMOVED_TAGS)
        furniture = self.tagged(*words.FURNITURE_TAGS)
        for i, attrs in enumerate(self.attrs):
            if attrs and self.kind[i] >= 0 and b"class" in attrs.lower():
                classes = attributes(attrs).get("class", "").lower()
                gone[i] |= any(k in classes for k in words.NOISE_CLASSES) or (
                    bool(furniture[i]) and any(k in classes for k in words.FURNITURE_CLASSES))
        change = np.zeros(len(self.raw) + 1, dtype=np.int32)
        np.add.at(change, self.start[gone], 1)
        np.add.at(change, self.element_ends()[gone], -1)
        return np.cumsum(change[:-1]) > 0

    def gaps(self) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end of the stretches between markup, page by page, empty ones too."""
        return np.sort(np.concatenate((self.page_start, self.end))), np.sort(np.concatenate((self.start, self.page_end)))

    def texts(self, removed: np.ndarray | None) -> pa.Array:
        """Text of each page, one line per text node, without scripts and styles and what is removed. Text around something
        removed is one node, as it is in the cleaned page."""
        low, high = self.gaps()
        code = self.end[self.tagged("script", "style")]
        use = (high > low) & ~np.isin(low, code)
        markup = self.start
        if removed is not None:
            use[use] = ~removed[low[use]]
            markup = markup[~removed[markup]]
        low, high = low[use], high[use]
        page = np.searchsorted(self.page_end, low)
        begins = np.ones(len(low), dtype=bool)
        begins[1:] = (np.diff(np.searchsorted(markup, low)) > 0) | (np.diff(page) > 0)
        nodes = _strings(self.bytes, low, high, np.flatnonzero(begins))
        refers = pc.match_substring(nodes, "&")
        plain = pa.array([entities.unescape(x) for x in nodes.filter(refers).to_pylist()], pa.string())
        nodes = pc.utf8_trim_whitespace(pc.replace_with_mask(nodes, refers, plain))
        full = pc.greater(pc.binary_length(nodes), 0)
        at = np.searchsorted(page[begins][full.to_numpy(zero_copy_only=False)], np.arange(len(self.page_end) + 1)).astype(np.int32)
        lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(at), nodes.filter(full)), "\n")
        lines = pc.replace_substring_regex(lines, rf"\n[{_SPACES}]*\n", "\n\n")
        return pc.utf8_trim_whitespace(pc.replace_substring_regex(lines, " +", " "))

    def kept(self, removed: np.ndarray) -> pa.Array:
        keep = ~removed
        keep[self.page_end] = False
        counts = np.concatenate(([0], np.cumsum(keep)))
        offsets = np.concatenate((counts[self.page_start[:1]], counts[self.page_end])).astype(np.int32)
        return pa.StringArray.from_buffers(len(self.page_end), pa.py_buffer(offsets), pa.py_buffer(self.bytes[keep]))

    def metas(self) -> list[list[dict[str, str]]]:
        """Attributes of the meta elements of each page, in order."""
        found: list[list[dict[str, str]]] = [[] for _ in self.page_end]
        for i in np.flatnonzero(self.tagged("meta")).tolist():
            found[self.page[i]].append(attributes(self.attrs[i]))
        return found

    def raw_contents(self, tag: str) -> Iterator[tuple[int, int, bytes]]:
        """(page, place of the tag, content) of the elements of a raw kind."""
        nexts = np.append(self.start, len(self.raw))
        for i in np.flatnonzero(self.tagged(tag) & (self.kind > 0)).tolist():
            yield int(self.page[i]), i, self.raw[self.end[i]: min(nexts[i + 1], self.page_end[self.page[i]])]

    def headings(self) -> list[str | None]:
        """The text of each page's first h1 if it is one string, in nested elements or none."""
        found: list[str | None] = [None] * len(self.page_end)
        firsts = np.flatnonzero(self.tagged("h1") & (self.kind > 0))
        _, first = np.unique(self.page[firsts], return_index=True)
        for i in firsts[first].tolist():
            page, at = self.page[i], i
            while at + 1 < len(self.start) and self.start[at + 1] == self.end[at] and self.kind[at + 1] > 0:
                at += 1
            stop = at + 1
            while stop < len(self.start) and self.page[stop] == page and self.kind[stop] < 0 and self.name[stop] != self.name[i] and self.start[stop + 1: stop + 2].tolist() == [self.end[stop]]:
                stop += 1
            if stop < len(self.start) and self.page[stop] == page and self.kind[stop] < 0 and self.name[stop] == self.name[i]:
                found[page] = entities.unescape(self.raw[self.end[at]: self.start[at + 1]].decode()).strip() or None
        return found


def attributes(attrs: bytes) -> dict[str, str]:
    """Attributes of a tag by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(attrs):
        found.setdefault(name.decode().lower(), entities.unescape((double or single or bare).decode()))
    return found


def _strings(data: np.ndarray, low: np.ndarray, high: np.ndarray, firsts: np.ndarray) -> pa.Array:
    """The stretches [low, high) of the bytes as strings; each goes from one of the ``firsts`` to before the next."""
    change = np.zeros(len(data) + 1, dtype=np.int32)
    change[low] += 1
    np.subtract.at(change, high, 1)
    offsets = np.concatenate(([0], np.cumsum(high - low)))[np.append(firsts, len(low))].astype(np.int32)
    return pa.StringArray.from_buffers(len(firsts), pa.py_buffer(offsets), pa.py_buffer(data[np.cumsum(change[:-1]) > 0]))


def _first_meta(metas: list[dict[str, str]], keys: tuple[tuple[str, str], ...]) -> str | None:
    """Content of the first meta of the first key that has one."""
    for attribute, value in keys:
        meta = next((m for m in metas if m.get(attribute) == value), None)
        if meta and meta.get("content", "").strip():
            return meta["content"].strip()
    return None


def _tagged(metas: list[dict[str, str]], attribute: str, prefix: str) -> list[tuple[str, str]]:
    return list({m[attribute]: m["content"] for m in metas if m.get(attribute, "").startswith(prefix) and m.get("content")}.items())


def _titles(index: PageIndex, metas: list[list[dict[str, str]]]) -> list[str | None]:
    found: list[str | None] = [None] * len(index.page_end)
    seen = set()
    for page, _, content in index.raw_contents("title"):
        if page not in seen:
            seen.add(page)
            found[page] = entities.unescape(content.decode()).strip() or None
    keys = (("property", "og:title"), ("name", "twitter:title"))
    return [t or _first_meta(m, keys) or h for t, m, h in zip(found, metas, index.headings(), strict=True)]


def _json_ld(index: PageIndex) -> list[list[str]]:
    found: list[list[str]] = [[] for _ in index.page_end]
    for page, i, content in index.raw_contents("script"):
        if attributes(index.attrs[i]).get("type") == "application/ld+json":
            found[page].append(content.decode().strip())
    return found


_DESCRIPTIONS = (("name", "description"), ("property", "og:description"), ("name", "twitter:description"))
_KINDS = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "map<string,string>": pa.map_(pa.string(), pa.string()),
          "int": pa.int32(), "boolean": pa.bool_()}


def _parts(pages: list[bytes], wanted: tuple[str, ...]) -> list[pa.Array]:
    index = PageIndex(pages)
    removed = index.removed() if {"clean_html", "text"} & set(wanted) else None
    metas = index.metas() if {"title", "description", "open_graph", "twitter_card"} & set(wanted) else []
    count = lambda *tags: np.bincount(index.page[index.tagged(*tags)], minlength=len(pages))
    make = {
        "clean_html": lambda: index.kept(removed), "text": lambda: index.texts(removed), "whole_text": lambda: index.texts(None),
        "title": lambda: _titles(index, metas), "description": lambda: [_first_meta(m, _DESCRIPTIONS) for m in metas],
        "json_ld": lambda: _json_ld(index), "open_graph": lambda: [_tagged(m, "property", "og:") for m in metas],
        "twitter_card": lambda: [_tagged(m, "name", "twitter:") for m in metas],
        "paragraphs": lambda: count("p"), "container": lambda: count("article", "main") > 0,
    }
    found = [(make[part](), _KINDS[PARTS[part]]) for part in wanted]
    return [a.cast(kind) if isinstance(a, pa.Array) else pa.array(a, type=kind) for a, kind in found]


def _page_slices(pages: list[bytes]) -> Iterator[list[bytes]]:
    """Some pages at a time, to bound the memory of a batch; a longer page stands alone."""
    at, size = 0, 0
    for i, page in enumerate(pages):
        if size and size + len(page) > _SLICE:
            yield pages[at:i]
            at, size = i, 0
        size += len(page)
    yield pages[at:]


def read(html, *wanted: str) -> Column:
    """Struct of the wanted parts (names of PARTS) of each page."""
    kind = "struct<" + ", ".join(f"{part}: {PARTS[part]}" for part in wanted) + ">"

    def index(pages: pa.Array) -> pa.Array:
        data = pages.fill_null("").cast(pa.binary()).to_pylist()
        found = [_parts(some, wanted) for some in _page_slices(data)] if data else []
        columns = [pa.concat_arrays([f[i] for f in found]) if found else pa.array([], _KINDS[PARTS[p]]) for i, p in enumerate(wanted)]
        return pa.StructArray.from_arrays(columns, names=list(wanted))

    return F.arrow_udf(index, kind)(F.col(html) if isinstance(html, str) else html)
