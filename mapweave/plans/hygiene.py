"""Column hygiene queries."""

from pyspark.sql import functions as F

from mapweave.functions import hygiene as hy
from mapweave.plans import sqlkit as q
from mapweave.plans.registry import register

_EMAIL_SQL = """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN
      substr(lower(c_mktsegment), 1, 1 + c_custkey % 3) || '@example.org' ELSE
      replace(lower(c_name), '#', '.') || '@' || lower(c_mktsegment) || '.example.org' END AS email, c_name, c_mktsegment,
      c_acctbal FROM customer"""


def people(t):
    kind = F.col("c_custkey") % 4
    return t.customer.select(
        "c_custkey", "c_name", "c_mktsegment", "c_acctbal",
        F.when(kind == 0, F.col("c_name"))
        .when(kind == 1, F.concat(F.left(F.lower("c_mktsegment"), (1 + F.col("c_custkey") % 3).cast("int")), F.lit("@example.org")))
        .otherwise(F.concat(F.replace(F.lower("c_name"), F.lit("#"), F.lit(".")), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.org")))
        .alias("email"),
    )


@register(
    "k1_mask_email",
    f"""SELECT c_custkey, CASE WHEN NOT contains(email, '@') THEN email
          WHEN length(split_part(email, '@', 1)) <= 2 THEN email[1] || '*@' || split_part(email, '@', 2)
          ELSE email[1] || '***' || right(split_part(email, '@', 1), 1) || '@' || split_part(email, '@', 2) END AS masked
        FROM ({_EMAIL_SQL})""",
)
def k1(t):
    return people(t).select("c_custkey", hy.mask_email("email").alias("masked"))


@register(
    "k2_mask_string",
    f"""SELECT c_custkey, CASE WHEN length(c_name) <= 8 THEN repeat('*', length(c_name)) ELSE
          left(c_name, 4) || repeat('*', length(c_name) - 8) || right(c_name, 4) END AS masked,
          CASE WHEN length(c_mktsegment) <= 8 THEN repeat('x', length(c_mktsegment)) ELSE
          left(c_mktsegment, 4) || repeat('x', length(c_mktsegment) - 8) || right(c_mktsegment, 4) END AS masked_segment
        FROM customer""",
)
def k2(t):
    return t.customer.select(
        "c_custkey", hy.mask_string("c_name").alias("masked"), hy.mask_string("c_mktsegment", 4, "x").alias("masked_segment")
    )


@register(
    "k3_truncate",
    """SELECT conv_id, turn, CASE WHEN length(text) <= 100 THEN text ELSE left(text, 97) || '...' END AS short
       FROM conversations""",
)
def k3(t):
    return t.conversations.select("conv_id", "turn", hy.truncate_text("text").alias("short"))


def _escape_sql(x):
    return (f"replace(replace(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), "
            "'''', '&#x27;')")


@register(
    "k4_escape_html",
    f"""SELECT page_id, md5({_escape_sql('html')}) AS escaped_hash, md5({_escape_sql(
        "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, "
        "'(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), "
        "'(?i)\\s+on\\w+\\s*=\\s*[\"''][^\"'']*[\"'']', '', 'g'), '(?i)javascript:', '', 'g'), '(?i)data:', '', 'g')"
    )}) AS cleaned_hash FROM pages""",
)
def k4(t):
    return t.pages.select(
        "page_id", F.md5(hy.escape_html("html")).alias("escaped_hash"), F.md5(hy.clean_html_text("html")).alias("cleaned_hash")
    )


_RAW_URL_SQL = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '  ' || url WHEN 1 THEN 'JavaScript:' || url
                  WHEN 2 THEN regexp_replace(url, '^https?://', '') ELSE url || '&a=''b''' END AS raw FROM pages"""


@register(
    "k5_clean_url",
    f"""SELECT page_id, CASE WHEN v = '' OR starts_with(lower(v), 'javascript:') OR starts_with(lower(v), 'data:') THEN ''
          ELSE {_escape_sql("CASE WHEN starts_with(v, 'http://') OR starts_with(v, 'https://') THEN v ELSE 'https://' || v END")}
          END AS clean FROM (SELECT page_id, trim(raw) AS v FROM ({_RAW_URL_SQL}))""",
)
def k5(t):
    kind = F.col("page_id") % 4
    raw = (
        F.when(kind == 0, F.concat(F.lit("  "), "url"))
        .when(kind == 1, F.concat(F.lit("JavaScript:"), "url"))
        .when(kind == 2, F.regexp_replace("url", "^https?://", ""))
        .otherwise(F.concat("url", F.lit("&a='b'")))
    )
    return t.pages.select("page_id", hy.clean_url(raw).alias("clean"))


@register(
    "k6_redact",
    f"""SELECT c_custkey, c_name AS name, '***REDACTED***' AS api_token, c_mktsegment AS note,
          '***REDACTED***' AS inner_secret FROM ({_EMAIL_SQL})""",
)
def k6(t):
    nested = people(t).select(
        "c_custkey",
        F.create_map(
            F.lit("name"), F.col("c_name"), F.lit("Api_Token"), F.col("email"), F.lit("note"), F.col("c_mktsegment")
        ).alias("attributes"),
        F.struct(F.col("c_acctbal").cast("string").alias("user_secret")).alias("account"),
    )
    return hy.redact(nested).select(
        "c_custkey", F.col("attributes")["name"].alias("name"), F.col("attributes")["Api_Token"].alias("api_token"),
        F.col("attributes")["note"].alias("note"), F.col("account.user_secret").alias("inner_secret"),
    )


def _any_sql(x, patterns):
    return "(" + " OR ".join("regexp_matches({}, '{}')".format(x, p.replace("'", "''")) for p in patterns) + ")"


@register(
    "k7_injection_flags",
    " UNION ALL ".join(
        f"""SELECT '{src}' AS source, {key} AS id, {_any_sql(col, hy.SQL_PATTERNS)} AS sql_flag,
            {_any_sql(col, hy.COMMAND_PATTERNS)} AS command_flag, {_any_sql(col, hy.XSS_PATTERNS)} AS xss_flag FROM {src}"""
        for src, key, col in (("pages", "page_id", "html"), ("documents", "doc_id", "text"))
    ),
)
def k7(t):
    def flags(df, source, key, col):
        return df.select(
            F.lit(source).alias("source"), F.col(key).alias("id"), hy.has_sql_injection(col).alias("sql_flag"),
            hy.has_command_injection(col).alias("command_flag"), hy.has_xss(col).alias("xss_flag"),
        )

    return flags(t.pages, "pages", "page_id", "html").unionByName(flags(t.documents, "documents", "doc_id", "text"))


@register(
    "k8_validation",
    f"""SELECT c_custkey,
          concat_ws('; ', CASE WHEN email = '' THEN 'Email is required' END,
            CASE WHEN NOT regexp_matches(lower(trim(email)), '{hy.EMAIL_PATTERN}') THEN 'Invalid email format' END) AS email_errors,
          concat_ws('; ', CASE WHEN NOT coalesce({q.scheme('email')} IN ('http','https'), FALSE) THEN 'URL scheme must be http or https' END,
            CASE WHEN {q.netloc('email')} = '' THEN 'URL must have a host' END) AS url_errors,
          CASE WHEN c_acctbal < 0 THEN 'must be at least 0.0' WHEN c_acctbal > 9000 THEN 'must be at most 9000.0' ELSE '' END
            AS balance_errors,
          CASE WHEN c_custkey % 2 = 0 THEN 'must be an integer' WHEN c_custkey > 100 THEN 'must be at most 100' ELSE '' END
            AS key_errors,
          CASE WHEN {_any_sql("c_mktsegment || ' or 1=1'", hy.SQL_PATTERNS)} THEN 'Search query contains SQL patterns' ELSE '' END
            AS query_errors
        FROM ({_EMAIL_SQL})""",
)
def k8(t):
    key_text = F.when(F.col("c_custkey") % 2 == 0, "n/a").otherwise(F.col("c_custkey").cast("string"))

    def joined(errors):
        return F.array_join(errors, "; ")

    return people(t).select(
        "c_custkey",
        joined(hy.email_errors("email")).alias("email_errors"),
        joined(hy.url_errors("email")).alias("url_errors"),
        joined(hy.number_errors(F.col("c_acctbal").cast("string"), "double", 0.0, 9000.0)).alias("balance_errors"),
        joined(hy.number_errors(key_text, "bigint", None, 100)).alias("key_errors"),
        joined(hy.query_errors(F.concat("c_mktsegment", F.lit(" or 1=1")))).alias("query_errors"),
    )
