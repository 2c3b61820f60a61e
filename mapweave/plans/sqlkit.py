"""SQL fragments shared by the side-by-side statements."""

from __future__ import annotations

from collections.abc import Sequence

from mapweave.functions import urls


def quoted(values: Sequence[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def scheme(x: str) -> str:
    return f"lower(regexp_extract({x}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1))"


def netloc(x: str) -> str:
    return f"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"


def path(x: str) -> str:
    return f"regexp_extract({x}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"


def query(x: str) -> str:
    return rf"regexp_extract({x}, '^[^?#]*\?([^#]*)', 1)"


def normalized(x: str) -> str:
    return (
        f"({scheme(x)} || '://' || lower({netloc(x)}) || regexp_replace({path(x)}, '/+$', '') || "
        f"CASE WHEN {query(x)} <> '' THEN '?' || {query(x)} ELSE '' END)"
    )


def valid_url(x: str) -> str:
    return f"({scheme(x)} IN ('http','https') AND {netloc(x)} <> '' AND contains({netloc(x)}, '.'))"


def bare(x: str) -> str:
    return rf"regexp_replace(lower({x}), '^www\.', '')"


def sphere_case(x: str, column: str) -> str:
    """CASE over the sphere rules giving sphere, confidence or method of URL ``x``."""
    domain = bare(netloc(x))
    position = {"sphere": 0, "confidence": 1, "method": 2}[column]

    def lit(v):
        return f"CAST({v} AS DOUBLE)" if isinstance(v, float) else f"'{v}'"

    arms = []
    for rule in urls.SPHERE_RULES:
        kind, values = rule[3], rule[4]
        if kind == "regex":
            test = f"regexp_matches({domain}, '{values}')"
        else:
            tests = [f"ends_with({domain}, '{v if v.startswith('.') else '.' + v}')" for v in values]
            if kind == "list":
                tests.append(f"{domain} IN ({quoted([v for v in values if not v.startswith('.')])})")
            test = "(" + " OR ".join(tests) + ")"
        arms.append(f"WHEN {test} THEN {lit(rule[position])}")
    default = ("general", 0.30, "default")[position]
    return "CASE " + " ".join(arms) + f" ELSE {lit(default)} END"


def sanitized(x: str) -> str:
    return f"substr(translate({x}, ' /:?&=', '______'), 1, 200)"
