"""Column expressions on URLs and domains."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions import words
from mapweave.functions.text import let

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"
_NETLOC = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_PATH = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def any_of(conditions: Sequence[Column]) -> Column:
    """OR of the conditions; false for none."""
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def scheme(url) -> Column:
    return F.lower(F.regexp_extract(_col(url), _SCHEME, 1))


def netloc(url) -> Column:
    """Host with port and user part, '' when the URL has none."""
    return F.regexp_extract(_col(url), _NETLOC, 1)


def path(url) -> Column:
    return F.regexp_extract(_col(url), _PATH, 1)


def query(url) -> Column:
    return F.regexp_extract(_col(url), _QUERY, 1)


def domain_or_first_segment(url) -> Column:
    """Netloc, else the first path segment ('example.com/x' without a scheme)."""
    host = netloc(url)
    return F.when(host == "", F.split(path(url), "/")[0]).otherwise(host)


def normalize_url(url) -> Column:
    """Form under which two URLs count as the same: no fragment, no trailing '/', lower-case host."""
    wanted = query(url)
    return F.concat(
        scheme(url),
        F.lit("://"),
        F.lower(netloc(url)),
        F.regexp_replace(path(url), "/+$", ""),
        F.when(wanted != "", F.concat(F.lit("?"), wanted)).otherwise(F.lit("")),
    )


def url_hash(url) -> Column:
    return F.md5(normalize_url(url))


def is_valid_url(url) -> Column:
    host = netloc(url)
    return scheme(url).isin("http", "https") & (host != "") & host.contains(".")


def bare_domain(domain) -> Column:
    """Lower case without a leading 'www.'."""
    return F.regexp_replace(F.lower(_col(domain)), r"^www\.", "")


def is_blacklisted(domain, blacklist: Sequence[str]) -> Column:
    return bare_domain(domain).isin(*blacklist) if blacklist else F.lit(False)


def is_whitelisted(domain, whitelist: Sequence[str]) -> Column:
    """Exact entry, or an entry '*.example.com' that the domain ends with."""
    bare = bare_domain(domain)
    exact = [p for p in whitelist if not p.startswith("*.")]
    suffixes = [p[1:] for p in whitelist if p.startswith("*.")]
    tests = [bare.endswith(s) for s in suffixes]
    if exact:
        tests.append(bare.isin(*exact))
    return any_of(tests)


def matches_tld(domain, tlds: Sequence[str]) -> Column:
    return any_of([F.lower(_col(domain)).endswith(t.lower()) for t in tlds])


def is_excluded(domain, excluded: Sequence[str]) -> Column:
    """The domain or one of its parents is in ``excluded``."""
    host = F.lower(_col(domain))
    return any_of([(host == x.lower()) | host.endswith("." + x.lower()) for x in excluded])


def same_domain_links(links, base) -> Column:
    """Links whose host equals that of ``base``, ignoring case."""
    return F.filter(_col(links), lambda link: F.lower(netloc(link)) == F.lower(netloc(base)))


def sanitize_node_id(raw) -> Column:
    """Node ids without blanks and URL punctuation, at most 200 characters."""
    return F.substring(F.translate(_col(raw), " /:?&=", "______"), 1, 200)


def node_identity(raw) -> Column:
    """``sanitize_node_id`` of a text that it can hold; of a longer one the beginning and a hash of the whole."""
    whole = _col(raw)
    marked = F.concat(F.substring(sanitize_node_id(whole), 1, 183), F.lit("_"), F.lpad(F.lower(F.hex(F.xxhash64(whole))), 16, "0"))
    return F.when(F.length(whole) > 200, marked).otherwise(sanitize_node_id(whole))


def url_terms(url) -> Column:
    """Words of the path: split on '/', '-', '_', three characters or more, lower case."""
    parts = F.split(F.regexp_replace(path(url), "^/+|/+$", ""), "[/_-]")
    return F.transform(F.filter(parts, lambda p: F.length(p) >= 3), lambda p: F.lower(p))


def _suffix_pattern(entries: Sequence[str]) -> str:
    """One pattern for a list: '.x' entries match as a suffix, others as the domain or a parent of it."""
    suffixes = [re.escape(e[1:]) for e in entries if e.startswith(".")]
    parents = [re.escape(e) for e in entries if not e.startswith(".")]
    parts = []
    if suffixes:
        parts.append(r"\.(" + "|".join(suffixes) + ")$")
    if parents:
        parts.append(r"(^|\.)(" + "|".join(parents) + ")$")
    return "|".join(parts)


#: (sphere, confidence, method, test) in the order in which the first match wins.
SPHERE_RULES = (
    ("academia", 0.95, "tld", "suffix", words.ACADEMIC_SUFFIXES),
    ("government", 0.95, "tld", "suffix", words.GOVERNMENT_SUFFIXES),
    ("academia", 0.90, "domain_list", "list", words.ACADEMIC_DOMAINS),
    ("government", 0.90, "domain_list", "list", words.GOVERNMENT_DOMAINS),
    ("news", 0.90, "domain_list", "list", words.NEWS_DOMAINS),
    ("activist", 0.85, "domain_list", "list", words.ACTIVIST_DOMAINS),
    ("international", 0.90, "domain_list", "list", words.INTERNATIONAL_DOMAINS),
    ("academia", 0.60, "pattern", "regex", "university|college|institute|research"),
    ("news", 0.50, "pattern", "regex", "news|times|post|daily|tribune|herald"),
    ("government", 0.50, "pattern", "regex", "ministry|parliament|senate|congress"),
)


def sphere(url) -> Column:
    """Struct (sphere, confidence, method) of the societal sphere a URL belongs to."""
    outcomes = [(r[0], r[1], r[2]) for r in SPHERE_RULES] + [("general", 0.30, "default"), ("unknown", 0.0, "error")]

    def first_match(domain: Column) -> Column:
        chain = F.when(domain.isNull(), len(outcomes))
        for number, (_, _, _, kind, values) in enumerate(SPHERE_RULES, start=1):
            chain = chain.when(domain.rlike(values if kind == "regex" else _suffix_pattern(values)), number)
        return chain.otherwise(len(outcomes) - 1)

    # The domain is bound to a name, so it is computed once for all rules even after the optimizer
    # has inlined the URL expression into a pushed filter.
    number = let(bare_domain(netloc(url)), first_match)
    table = F.array(
        *[
            F.struct(F.lit(s).alias("sphere"), F.lit(c).alias("confidence"), F.lit(m).alias("method"))
            for s, c, m in outcomes
        ]
    )
    return F.element_at(table, number)


def classify_spheres(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Adds sphere, confidence and method of every row's URL."""
    return df.select("*", sphere(url_col).alias("__s")).select(*df.columns, "__s.*")


def filter_results(
    df: DataFrame,
    blacklist: Sequence[str] = (),
    whitelist: Sequence[str] = (),
    tlds: Sequence[str] = (),
    spheres: Sequence[str] = (),
    url_col: str = "url",
    domain_col: str = "domain",
) -> DataFrame:
    """Results that pass every given rule; an empty rule list means no rule."""
    out = df.filter((F.col(url_col) != "") & (F.col(domain_col) != "") & is_valid_url(url_col))
    if blacklist:
        out = out.filter(~is_blacklisted(domain_col, blacklist))
    if whitelist:
        out = out.filter(is_whitelisted(domain_col, whitelist))
    if tlds:
        out = out.filter(matches_tld(domain_col, tlds))
    if spheres:
        out = out.filter(sphere(url_col)["sphere"].isin(*spheres))
    return out


def sphere_distribution(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Results per sphere. Classified per distinct URL, then weighted by its rows."""
    per_url = df.filter(F.col(url_col) != "").groupBy(url_col).agg(F.count(F.lit(1)).alias("__n"))
    return (
        per_url.select(sphere(url_col)["sphere"].alias("sphere"), "__n")
        .groupBy("sphere")
        .agg(F.sum("__n").cast("bigint").alias("n_results"))
    )
