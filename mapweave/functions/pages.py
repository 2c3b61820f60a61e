"""Column expressions on raw pages: titles, links, metadata, flags."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mapweave.functions import pageindex, urls, words
from mapweave.functions.text import let

#: Longest stored text in UTF-8 bytes, and the notes of cut or binary texts.
TRUNCATED_NOTE = "\n\n[... Content truncated due to size limits ...]"
BINARY_NOTE = "[Binary content - could not extract text]"

_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def unescape(text: Column) -> Column:
    """The common character references of HTML, '&amp;' last."""
    for escaped, raw in _ENTITIES:
        text = F.replace(text, F.lit(escaped), F.lit(raw))
    return text


def _attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a start tag: in double quotes, in single quotes or bare; empty without it."""
    part = lambda group: F.regexp_extract(tag, rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", group)
    return F.concat(part(1), part(2), part(3))


def _without_code(html: Column) -> Column:
    """Without comments, scripts and styles: nothing in them is markup."""
    return F.regexp_replace(html, r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>", "")


def clean_html(html) -> Column:
    """Page without scripts, styles, frames, navigation blocks and advertising; its other bytes as they are."""
    return pageindex.read(html, "clean_html")["clean_html"]


def extract_text(html, clean: bool = True) -> Column:
    """Visible text of a page, one line per text node; ``clean``: without navigation blocks and advertising."""
    part = "text" if clean else "whole_text"
    return pageindex.read(html, part)[part]


def title(html) -> Column:
    """<title>, else og:title, else twitter:title, else a first <h1> that holds one string."""
    return pageindex.read(html, "title")["title"]


def meta_description(html) -> Column:
    """Meta description, else og:description, else twitter:description."""
    return pageindex.read(html, "description")["description"]


def _without_dot_segments(path: Column) -> Column:
    """Path with '.' and '..' resolved; a final dot segment leaves a trailing '/'."""
    parts = F.split(path, "/")
    last = F.element_at(parts, -1)

    def step(kept, part):
        up = F.slice(kept, 1, F.greatest(F.size(kept) - 1, F.lit(1)))
        return F.when(part == "..", up).when(part == ".", kept).otherwise(F.concat(kept, F.array(part)))

    rest = F.aggregate(F.slice(parts, 2, F.size(parts)), F.array(F.lit("")), step)
    joined = F.array_join(rest, "/")
    closed = F.when(last.isin(".", "..") & ~joined.endswith("/"), F.concat(joined, F.lit("/"))).otherwise(joined)
    return F.when(path.contains("/."), closed).otherwise(path)


def resolve(link: Column, base: Column) -> Column:
    """Absolute form of a link on page ``base``: scheme, host and path by the usual rules, no fragment."""
    wanted = urls.query(link)
    tail = F.when(wanted != "", F.concat(F.lit("?"), wanted)).otherwise(F.lit(""))
    own_scheme, own_host, own_path = urls.scheme(link), urls.netloc(link), urls.path(link)
    base_scheme, base_host, base_path = urls.scheme(base), urls.netloc(base), urls.path(base)
    folder = F.when(base_path == "", F.lit("/")).otherwise(F.regexp_replace(base_path, "[^/]*$", ""))
    relative = (
        F.when(own_path == "", base_path)
        .when(own_path.startswith("/"), own_path)
        .otherwise(F.concat(folder, own_path))
    )
    inherited = F.when((own_path == "") & (wanted == ""), F.when(urls.query(base) != "", F.concat(F.lit("?"), urls.query(base))).otherwise(F.lit(""))).otherwise(tail)
    return (
        F.when(own_scheme != "", F.concat(own_scheme, F.lit("://"), own_host, own_path, tail))
        .when(own_host != "", F.concat(base_scheme, F.lit("://"), own_host, own_path, tail))
        .otherwise(F.concat(base_scheme, F.lit("://"), base_host, _without_dot_segments(relative), inherited))
    )


def links(html, base) -> Column:
    """Distinct absolute http(s) links of a page in first-seen order."""
    tags = F.regexp_extract_all(_without_code(_col(html)), F.lit(r"""(?is)<a\s(?:"[^"]*"|'[^']*'|[^>"'])*>"""), 0)
    hrefs = F.transform(tags, lambda tag: _attribute(tag, "href"))
    low = ("#", "javascript:", "mailto:", "tel:")

    def usable(href):
        out = href != ""
        for prefix in low:
            out = out & ~href.startswith(prefix)
        return out

    absolute = F.transform(F.filter(hrefs, usable), lambda h: resolve(unescape(h), _col(base)))
    return F.array_distinct(F.filter(absolute, lambda u: urls.scheme(u).isin("http", "https")))


def structured_data(html) -> Column:
    """Struct (json_ld array of valid JSON texts, open_graph map, twitter_card map)."""
    parts = pageindex.read(html, "json_ld", "open_graph", "twitter_card")
    return let(parts, lambda p: F.struct(
        F.filter(p["json_ld"], lambda s: F.try_parse_json(s).isNotNull()).alias("json_ld"),
        p["open_graph"].alias("open_graph"), p["twitter_card"].alias("twitter_card")))


def has_content(length, paragraphs, container, min_length: int = 500) -> Column:
    """Enough text, and an article or main element or three paragraphs."""
    return (_col(length) >= min_length) & (_col(container) | (_col(paragraphs) >= 3))


def is_content_page(html, text, min_length: int = 500) -> Column:
    """``has_content`` of a page whose text is known."""
    return let(pageindex.read(html, "paragraphs", "container"),
               lambda p: has_content(F.length(_col(text)), p["paragraphs"], p["container"], min_length))


def is_challenge_page(html) -> Column:
    low = F.lower(_col(html))
    named = urls.any_of([F.contains(low, F.lit(p)) for p in words.CHALLENGE_PHRASES])
    return named | (F.contains(low, F.lit("recaptcha")) & (F.length(_col(html)) < 5000))


def is_rate_limited(html, status) -> Column:
    low = F.lower(_col(html))
    named = urls.any_of([F.contains(low, F.lit(p)) for p in words.RATE_LIMIT_PHRASES])
    return F.coalesce(_col(status) == 429, F.lit(False)) | named


def looks_binary(text, sample: int | None = None) -> Column:
    """More than 100 control characters in the text, or among its first ``sample`` characters if that is given."""
    plain = F.replace(_col(text), F.lit("\x00"), F.lit(""))
    if sample is not None:
        plain = F.substring(plain, 1, sample)
    return F.regexp_count(plain, F.lit(r"[\x01-\x08\x0B\x0C\x0E-\x1F]")) > 100


def clean_text(text, max_bytes: int | None = None, sample: int | None = None) -> Column:
    """Without NUL characters; a note in place of binary content (``looks_binary``); if ``max_bytes`` is given, at most so much
    UTF-8 and a note."""
    plain = F.replace(_col(text), F.lit("\x00"), F.lit(""))
    if max_bytes is None:
        return F.when(looks_binary(text, sample), F.lit(BINARY_NOTE)).otherwise(plain)
    head = F.substring(F.encode(plain, "UTF-8"), 1, max_bytes)
    whole = F.make_valid_utf8(head.cast("string"))
    # A character cut in two becomes one replacement mark at the end, which is dropped.
    cut = F.when(F.is_valid_utf8(head.cast("string")), head.cast("string")).otherwise(
        F.regexp_replace(whole, "�$", "")
    )
    return (
        F.when(looks_binary(text, sample), F.lit(BINARY_NOTE))
        .when(F.octet_length(plain) > max_bytes, F.concat(cut, F.lit(TRUNCATED_NOTE)))
        .otherwise(plain)
    )
