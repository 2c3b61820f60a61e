"""Masking, escaping, redaction and validation of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mapweave.functions import urls

# -- fixed values: patterns and limits -----------------------------------------

EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
SQL_PATTERNS = (
    r"(?i)(\bUNION\b|\bSELECT\b|\bINSERT\b|\bUPDATE\b|\bDELETE\b|\bDROP\b)",
    r"(?i)(--|;|/\*|\*/|xp_|sp_)",
    r"(?i)(\bOR\b|\bAND\b)\s+\d+\s*=\s*\d+",
)
COMMAND_PATTERNS = (r"[;&|`$()]", r"(?i)(bash|sh|cmd|powershell|eval|exec)")
XSS_PATTERNS = (
    r"(?is)<script[^>]*>.*?</script>",
    r"(?i)javascript:",
    r"(?i)on\w+\s*=",
    r"(?i)<iframe[^>]*>",
)
MAX_EMAIL, MAX_URL, MAX_QUERY = 254, 2048, 500
SENSITIVE_NAMES = (
    "password", "password_hash", "hashed_password", "secret", "secret_key", "api_key", "token", "access_token",
    "refresh_token", "private_key", "ssh_key", "credit_card", "ssn", "social_security",
)
REDACTED = "***REDACTED***"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def mask_email(email) -> Column:
    """First and last letter of the user part; unchanged without '@'."""
    email = _col(email)
    user = F.substring_index(email, "@", 1)
    domain = F.substr(email, F.instr(email, "@"))
    masked = F.when(F.length(user) <= 2, F.concat(F.left(user, F.lit(1)), F.lit("*"))).otherwise(
        F.concat(F.left(user, F.lit(1)), F.lit("***"), F.right(user, F.lit(1)))
    )
    return F.when(F.contains(email, F.lit("@")), F.concat(masked, domain)).otherwise(email)


def mask_string(text, visible: int = 4, mark: str = "*") -> Column:
    """``visible`` characters at both ends, marks between; all marks when nothing would be hidden."""
    text = _col(text)
    size = F.length(text)
    return F.when(size <= 2 * visible, F.repeat(F.lit(mark), size)).otherwise(
        F.concat(
            F.left(text, F.lit(visible)), F.repeat(F.lit(mark), size - 2 * visible), F.right(text, F.lit(visible))
        )
    )


def truncate_text(text, max_length: int = 100, suffix: str = "...") -> Column:
    """At most ``max_length`` characters, the suffix included."""
    text = _col(text)
    return F.when(F.length(text) <= max_length, text).otherwise(
        F.concat(F.left(text, F.lit(max_length - len(suffix))), F.lit(suffix))
    )


def escape_html(text) -> Column:
    out = F.coalesce(_col(text), F.lit(""))
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(escaped))
    return out


def clean_html_text(text) -> Column:
    """Without scripts, styles, event handlers and script or data protocols; then escaped."""
    out = F.coalesce(_col(text), F.lit(""))
    for pattern in (
        r"(?is)<script[^>]*>.*?</script>",
        r"(?is)<style[^>]*>.*?</style>",
        r"""(?i)\s+on\w+\s*=\s*["'][^"']*["']""",
        r"(?i)javascript:",
        r"(?i)data:",
    ):
        out = F.regexp_replace(out, pattern, "")
    return escape_html(out)


def clean_url(url) -> Column:
    """Trimmed and escaped, https:// added where a scheme is missing; '' for script and data URLs."""
    url = F.trim(F.coalesce(_col(url), F.lit("")))
    low = F.lower(url)
    full = F.when(url.startswith("http://") | url.startswith("https://"), url).otherwise(F.concat(F.lit("https://"), url))
    empty = (url == "") | low.startswith("javascript:") | low.startswith("data:")
    return F.when(empty, F.lit("")).otherwise(escape_html(full))


def is_sensitive(name: Column) -> Column:
    out = F.lit(False)
    for part in SENSITIVE_NAMES:
        out = out | F.contains(F.lower(name), F.lit(part))
    return out


def redact_map(values) -> Column:
    """Values of sensitive keys replaced in a map of strings."""
    return F.transform_values(_col(values), lambda k, v: F.when(is_sensitive(k), F.lit(REDACTED)).otherwise(v))


def redact(df: DataFrame) -> DataFrame:
    """Sensitive columns and nested fields replaced, through structs, arrays and maps of any depth.

    A sensitive map entry becomes the mark where values are texts, else null, as a map has one value type.
    """

    def nested(kind: T.DataType) -> bool:
        return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))

    def clean(value: Column, kind: T.DataType, name: str) -> Column:
        if any(part in name.lower() for part in SENSITIVE_NAMES):
            return F.lit(REDACTED)
        if isinstance(kind, T.StructType):
            fields = [clean(value[f.name], f.dataType, f.name).alias(f.name) for f in kind.fields]
            return F.when(value.isNotNull(), F.struct(*fields))
        if isinstance(kind, T.ArrayType) and nested(kind.elementType):
            return F.transform(value, lambda x: clean(x, kind.elementType, ""))
        if isinstance(kind, T.MapType) and isinstance(kind.keyType, T.StringType):
            if isinstance(kind.valueType, T.StringType):
                return redact_map(value)
            return F.transform_values(value, lambda k, v: F.when(~is_sensitive(k), clean(v, kind.valueType, "")))
        if isinstance(kind, T.MapType) and nested(kind.valueType):
            return F.transform_values(value, lambda k, v: clean(v, kind.valueType, ""))
        return value

    return df.select(*[clean(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def _matches(text: Column, patterns: Sequence[str]) -> Column:
    out = F.lit(False)
    for pattern in patterns:
        out = out | text.rlike(pattern)
    return out


def has_sql_injection(text) -> Column:
    return _matches(_col(text), SQL_PATTERNS)


def has_command_injection(text) -> Column:
    return _matches(_col(text), COMMAND_PATTERNS)


def has_xss(text) -> Column:
    return _matches(_col(text), XSS_PATTERNS)


def _errors(*checks: tuple[Column, str]) -> Column:
    """Messages of the failed checks, in order."""
    return F.array_compact(F.array(*[F.when(test, F.lit(message)) for test, message in checks]))


def email_errors(email) -> Column:
    value = F.lower(F.trim(F.coalesce(_col(email), F.lit(""))))
    return _errors(
        (value == "", "Email is required"),
        (F.length(value) > MAX_EMAIL, "Email is too long"),
        ((value != "") & ~value.rlike(EMAIL_PATTERN), "Invalid email format"),
    )


def url_errors(url) -> Column:
    value = F.trim(F.coalesce(_col(url), F.lit("")))
    return _errors(
        (value == "", "URL is required"),
        (F.length(value) > MAX_URL, "URL is too long"),
        ((value != "") & ~urls.scheme(value).isin("http", "https"), "URL scheme must be http or https"),
        ((value != "") & (urls.netloc(value) == ""), "URL must have a host"),
        (has_xss(value), "URL contains dangerous content"),
    )


def query_errors(query) -> Column:
    value = F.trim(F.coalesce(_col(query), F.lit("")))
    return _errors(
        (value == "", "Search query is required"),
        (F.length(value) > MAX_QUERY, "Search query is too long"),
        (has_sql_injection(value), "Search query contains SQL patterns"),
    )


def number_errors(value, kind: str, low=None, high=None) -> Column:
    """Range check of a text column read as ``bigint`` or ``double``."""
    number = _col(value).try_cast(kind)
    checks = [(number.isNull(), "must be an integer" if kind == "bigint" else "must be a number")]
    if low is not None:
        checks.append((F.coalesce(number < low, F.lit(False)), f"must be at least {low}"))
    if high is not None:
        checks.append((F.coalesce(number > high, F.lit(False)), f"must be at most {high}"))
    return _errors(*checks)
