"""Page queries."""

from pyspark.sql import functions as F

from mapweave.functions import pageindex, words
from mapweave.functions import pages as pg
from mapweave.functions import text as tx
from mapweave.operators import pages as ops
from mapweave.plans import sqlkit as q
from mapweave.plans.registry import register
from mapweave.plans.roles import with_roles


# What no reader of pages may take for markup: a comment, a script, quotes around ">".
_COMMENT = ("<!-- <title>old</title><meta name='description' content='old'><script type='application/ld+json'>{\"id\": 0}</script>"
            "<p><p><p><article><h1>old</h1></article> -->")
_SCRIPT = "<script data-x=\"a > b\">var s = '<title>js</title><meta property=\"og:title\" content=\"js\"><article><p><p><p>';</script>"
# Blocks that are taken out of a page, with tags that are left open, void elements and class names in any case.
_FURNITURE = ("<NAV title='x > y' class='Top-Menu'><ul><li>menu<li>more <b>bold</ul><p>open</NAV><div class=\"big Popup\"><div>gone<br></div>"
              "<img class='ad-1' src=x>also</div><hr class=comment><noscript>no <i>script</noscript>")


def decoys(html="html"):
    """Pages with such markup put in front of their head's and body's content."""
    head = F.replace(F.col(html) if isinstance(html, str) else html, F.lit("<head>"), F.lit(f"<head>{_COMMENT}{_SCRIPT}"))
    return F.replace(head, F.lit("<body>"), F.lit(f"<body>{_FURNITURE}"))


@register(
    "c1_clean_html",
    """SELECT page_id, replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', '', 'g'), '<head>', '<head>%s')
          AS html FROM pages""" % _COMMENT.replace("'", "''"),
)
def c1(t):
    return t.pages.select("page_id", pg.clean_html(decoys()).alias("html"))


# The given pages hold no removed blocks besides scripts and styles, so their text is plain tag removal. References are read as HTML reads them:
# these names also count without a semicolon (titles of the given pages are cut inside "&amp;").
_TEXT_SQL = r"""SELECT page_id, html, trim(regexp_replace(array_to_string(list_filter(list_transform(string_split_regex(
      regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', '<x>', 'g'), '<[^>]*>'),
      lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        x, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&copy;?', '©', 'g'), '&middot;?', '·', 'g'), '&amp;?', '&', 'g'),
        '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)), ' +', ' ', 'g'))
      AS text FROM pages"""


@register("c2_extract_text", f"SELECT page_id, text FROM ({_TEXT_SQL})")
def c2(t):
    return t.pages.select("page_id", pg.extract_text(decoys()).alias("text"))


def _unescape_sql(x):
    """References as HTML reads them: names without "#" also count without a semicolon."""
    for a, b in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "''"), ("&#x27;", "''"), ("&nbsp;?", " "), ("&amp;?", "&")):
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return x


_TITLE_SQL = "nullif(trim(" + _unescape_sql("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)") + "), '')"
_H1_SQL = "nullif(trim(" + _unescape_sql("regexp_extract(html, '(?is)<h1[^>]*>([^<]*)</h1>', 1)") + "), '')"

# Pages with their title moved to a meta tag or dropped, so every branch is used.
_VARIANT_SQL = """SELECT page_id, url, CASE page_id % 4
    WHEN 1 THEN regexp_replace(html, '<title>([^<]*)</title>', '<meta property="og:title" content="og \\1">')
    WHEN 2 THEN regexp_replace(html, '<title>([^<]*)</title>', '<meta content="tw \\1" name="twitter:title">')
    WHEN 3 THEN regexp_replace(html, '<title>([^<]*)</title>', '') ELSE html END AS html FROM pages"""


def variants(t):
    kind = F.col("page_id") % 4
    pattern = "<title>([^<]*)</title>"
    html = (
        F.when(kind == 1, F.regexp_replace("html", pattern, '<meta property="og:title" content="og $1">'))
        .when(kind == 2, F.regexp_replace("html", pattern, '<meta content="tw $1" name="twitter:title">'))
        .when(kind == 3, F.regexp_replace("html", pattern, ""))
        .otherwise(F.col("html"))
    )
    return t.pages.select("page_id", "url", html.alias("html"))


def _content_sql(prefix):
    return "nullif(trim(" + _unescape_sql(f"regexp_extract(html, 'content=\"({prefix}[^\"]*)\"', 1)") + "), '')"


@register(
    "c3_title",
    f"""SELECT page_id, coalesce({_TITLE_SQL}, {_content_sql('og ')}, {_content_sql('tw ')}, {_H1_SQL}) AS title
        FROM ({_VARIANT_SQL})""",
)
def c3(t):
    return variants(t).select("page_id", pg.title(decoys()).alias("title"))


@register(
    "c4_meta_description",
    f"""SELECT page_id, CASE WHEN page_id % 4 IN (1, 2) THEN 'a > b: ' || trim({_unescape_sql("regexp_extract(html, '<title>([^<]*)</title>', 1)")})
        END AS description FROM pages""",
)
def c4(t):
    kind = F.col("page_id") % 4
    pattern = "<title>([^<]*)</title>"
    html = F.when(kind == 1, F.regexp_replace("html", pattern, '<meta name="description" content="a > b: $1"/>')).when(
        kind == 2, F.regexp_replace("html", pattern, "<META content='a > b: $1' property=og:description>")
    ).otherwise(F.col("html"))
    return t.pages.select("page_id", pg.meta_description(decoys(html)).alias("description"))


@register(
    "c5_links",
    f"""SELECT page_id, array_to_string(links, ' ') AS links FROM (
          SELECT page_id, list_transform(list_distinct_ordered, lambda h: {q.scheme('url')} || '://' || {q.netloc('url')} || h) AS links
          FROM (SELECT page_id, url, list_filter(hs, lambda h, i: list_position(hs, h) = i) AS list_distinct_ordered
                FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages)))""",
)
def c5(t):
    return t.pages.select("page_id", F.array_join(pg.links("html", "url"), " ").alias("links"))


@register(
    "c6_structured_data",
    """SELECT page_id, page_id % 3 AS n_json_ld, 'page ' || CAST(page_id AS VARCHAR) || ' > 0' AS og_title,
          CASE WHEN page_id % 2 = 0 THEN 'summary ' || CAST(page_id % 7 AS VARCHAR) END AS twitter_card,
          CASE WHEN page_id % 3 > 0 THEN CAST(page_id AS VARCHAR) END AS json_id FROM pages""",
)
def c6(t):
    number = F.col("page_id").cast("string")
    script = F.concat(F.lit('<script type="application/ld+json">{"id": '), number, F.lit("}</script>"))
    card = F.concat(F.lit("<meta name='twitter:card' content='summary "), (F.col("page_id") % 7).cast("string"), F.lit("'>"))
    block = F.concat(
        F.lit('<head><meta property="og:title" content="first"><meta property="og:title" content="page '), number, F.lit(' > 0">'),
        F.when(F.col("page_id") % 2 == 0, card).otherwise(F.lit("")), F.lit('<script type="application/ld+json">{broken</script>'),
        F.repeat(script, (F.col("page_id") % 3).cast("int")),
    )
    html = F.replace(F.col("html"), F.lit("<head>"), block)
    found = t.pages.select("page_id", pg.structured_data(decoys(html)).alias("s"))
    return found.select(
        "page_id",
        F.size("s.json_ld").cast("bigint").alias("n_json_ld"),
        F.col("s.open_graph")["og:title"].alias("og_title"),
        F.col("s.twitter_card")["twitter:card"].alias("twitter_card"),
        F.get_json_object(F.get("s.json_ld", 0), "$.id").alias("json_id"),
    )


@register(
    "c7_content_page",
    """SELECT page_id, length(html) >= 4000 AND (regexp_matches(html, '(?i)<(article|main)[\\s>]')
          OR len(regexp_extract_all(html, '(?i)<p[\\s>]')) >= 3) AS by_markup FROM pages""",
)
def c7(t):
    furniture_has = F.regexp_replace(decoys(), r"<p>open", "open")  # the block's own paragraph
    return t.pages.select("page_id", pg.is_content_page(furniture_has, "html", 4000).alias("by_markup"))


@register(
    "c7b_content_page_text",
    f"""SELECT page_id, text, length(text) >= 500 AND (regexp_matches(html, '(?i)<(article|main)[\\s>]')
          OR len(regexp_extract_all(html, '(?i)<p[\\s>]')) >= 3) AS is_content FROM ({_TEXT_SQL})""",
)
def c7b(t):
    found = t.pages.select("page_id", pageindex.read("html", "text", "paragraphs", "container").alias("p")).select("page_id", "p.*")
    return found.select("page_id", "text", pg.has_content(F.length("text"), "paragraphs", "container").alias("is_content"))


@register(
    "c8_text_statistics",
    """SELECT doc_id, CAST(len(regexp_extract_all(text, '\\S+')) AS BIGINT) AS words, length(text) AS characters,
          CAST(len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS BIGINT) AS lines FROM documents""",
)
def c8(t):
    return t.documents.select(
        "doc_id", tx.word_count("text").alias("words"), F.length("text").cast("bigint").alias("characters"),
        tx.line_count("text").alias("lines"),
    )


def _vote_sql():
    codes = sorted(words.LANGUAGE_MARKERS)
    hits = ", ".join(
        f"len(list_filter(ws, lambda w: w IN ({q.quoted(words.LANGUAGE_MARKERS[c])}))) AS h_{c}" for c in codes
    )
    best = "greatest(" + ", ".join(f"h_{c}" for c in codes) + ")"
    arms = " ".join(f"WHEN h_{c} = {best} THEN '{c}'" for c in codes)
    return f"""SELECT doc_id, CASE WHEN length(trim(text)) < 50 OR {best} = 0 THEN NULL {arms} END AS language
        FROM (SELECT doc_id, text, {hits} FROM (SELECT doc_id, text,
              string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}]+') AS ws FROM documents))"""


@register("c9_language", _vote_sql())
def c9(t):
    return t.documents.select("doc_id", tx.detect_language("text").alias("language"))


def _phrases_sql(x, phrases):
    return "(" + " OR ".join(f"contains(lower({x}), '{p}')" for p in phrases) + ")"


_MARKED_SQL = """SELECT page_id, CASE page_id % 5 WHEN 0 THEN html || 'Please verify you are a HUMAN' WHEN 1 THEN html || 'reCAPTCHA'
    WHEN 2 THEN html || 'Too Many Requests' ELSE html END AS html, CASE WHEN page_id % 7 = 0 THEN 429 ELSE 200 END AS code FROM pages"""


@register(
    "c10_challenge_flags",
    f"""SELECT page_id, {_phrases_sql('html', words.CHALLENGE_PHRASES)} OR (contains(lower(html), 'recaptcha') AND length(html) < 5000)
          AS is_challenge, code = 429 OR {_phrases_sql('html', words.RATE_LIMIT_PHRASES)} AS is_limited FROM ({_MARKED_SQL})""",
)
def c10(t):
    kind = F.col("page_id") % 5
    note = F.when(kind == 0, "Please verify you are a HUMAN").when(kind == 1, "reCAPTCHA").when(kind == 2, "Too Many Requests")
    marked = t.pages.select(
        "page_id", F.concat("html", F.coalesce(note, F.lit(""))).alias("html"),
        F.when(F.col("page_id") % 7 == 0, 429).otherwise(200).alias("code"),
    )
    return marked.select(
        "page_id", pg.is_challenge_page("html").alias("is_challenge"), pg.is_rate_limited("html", "code").alias("is_limited")
    )


@register(
    "c11_clean_text",
    """SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'success' END AS status,
          CASE WHEN doc_id % 10 = 0 THEN NULL ELSE md5(text) END AS text_hash FROM documents""",
)
def c11(t):
    noise = F.concat(F.repeat(F.lit("\x01"), 150), "text")
    binary = F.col("doc_id") % 10 == 0
    body = F.when(binary, noise).otherwise(F.concat(F.lit("\x00"), "text"))
    rows = t.documents.select("doc_id", body.alias("html"), body.alias("text"), F.lit("success").alias("status"))
    # the rule's own numbers: 900,000 bytes are stored, the first 1000 characters tell
    found = ops.clean_contents(rows, max_bytes=900_000, sample=1000)
    return found.select("doc_id", "status", F.md5("text").alias("text_hash"))


_FETCHED_SQL = """SELECT u.url, CASE WHEN length(d.text) < 800 THEN 'failed' ELSE 'success' END AS status, 1 + d.doc_id % 2 AS depth,
    CASE WHEN length(d.text) >= 800 THEN d.text END AS text, CAST(0 AS BIGINT) AS word_count
    FROM content_urls u JOIN documents d ON d.doc_id = u.content_id"""


@register(
    "c12_snippet_fallback",
    with_roles(
        "content_urls", "search_results", f=_FETCHED_SQL,
        s="SELECT url, arg_min(title, result_id) AS st, arg_min(description, result_id) AS sd FROM search_results GROUP BY url",
        j="""SELECT f.*, st, sd, f.status = 'failed' AND depth = 1 AND coalesce(sd, '') <> '' AS u FROM f LEFT JOIN s
             ON f.url = s.url""",
        body="""SELECT url, depth, CASE WHEN u THEN 'success' ELSE status END AS status, CASE WHEN u THEN sd ELSE md5(text) END AS text,
                  CASE WHEN u THEN CAST(len(regexp_extract_all(sd, '\\S+')) AS BIGINT) ELSE word_count END AS word_count,
                  CASE WHEN u THEN st END AS title,
                  CASE WHEN u THEN 'Used search snippet (original error: timeout)' ELSE 'timeout' END AS error_message FROM j""",
    ),
)
def c12(t):
    short = F.length("text") < 800
    fetched = t.content_urls.join(t.documents.select(F.col("doc_id").alias("content_id"), "text"), "content_id").select(
        "url", F.when(short, "failed").otherwise("success").alias("status"), (1 + F.col("content_id") % 2).alias("depth"),
        F.when(~short, F.md5("text")).alias("text"), F.lit(0).cast("bigint").alias("word_count"),
        F.lit(None).cast("string").alias("title"), F.lit("timeout").alias("error_message"),
    )
    return ops.snippet_fallback(fetched, t.search_results)


# Links between the given pages: the page's own links only point outside the table.
_PAGE_LINKS_SQL = """SELECT p.url, o.url AS link FROM (SELECT page_id, url, len(hs) AS k, unnest(generate_series(1, len(hs))) AS i, hs
      FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)"', 1) AS hs FROM pages)) p
    JOIN pages o ON o.page_id = (p.page_id * 7 + (p.i - 1) * 13 + length(p.hs[p.i])) % ((SELECT max(page_id) FROM pages) + 1)"""
_PAGE_STATUS_SQL = "SELECT url, CASE WHEN page_id % 9 = 0 THEN 'failed' ELSE 'success' END AS status FROM pages"


def page_links(t):
    hrefs = F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)
    last = t.pages.agg(F.max("page_id").alias("m")).scalar()
    target = (F.col("page_id") * 7 + F.col("i") * 13 + F.length("h")) % (last + 1)
    found = t.pages.select("page_id", "url", F.posexplode(hrefs).alias("i", "h")).select("url", target.alias("to"))
    return found.join(t.pages.select(F.col("page_id").alias("to"), F.col("url").alias("link")), "to").select("url", "link")


def page_status(t):
    return t.pages.select("url", F.when(F.col("page_id") % 9 == 0, "failed").otherwise("success").alias("status"))


@register(
    "c13_link_levels",
    with_roles(
        links=_PAGE_LINKS_SQL, st=_PAGE_STATUS_SQL,
        l1="SELECT url, 1 AS depth, status = 'success' AS scraped FROM st WHERE contains(url, '/es/')",
        l2="""SELECT DISTINCT s.url, 2 AS depth, status = 'success' AS scraped FROM links JOIN st s ON s.url = link
              WHERE links.url IN (SELECT url FROM l1 WHERE scraped) AND link NOT IN (SELECT url FROM l1 WHERE scraped)
                AND regexp_matches(link, '//[^/]*[.](com|org)(/|$)')""",
        a2="SELECT * FROM l1 UNION ALL SELECT * FROM l2",
        l3="""SELECT DISTINCT s.url, 3 AS depth, status = 'success' AS scraped FROM links JOIN st s ON s.url = link
              WHERE links.url IN (SELECT url FROM a2 WHERE scraped) AND link NOT IN (SELECT url FROM a2 WHERE scraped)
                AND regexp_matches(link, '//[^/]*[.](com|org)(/|$)')""",
        body="SELECT url, CAST(depth AS BIGINT) AS depth, scraped FROM (SELECT * FROM a2 UNION ALL SELECT * FROM l3)",
    ),
)
def c13(t):
    seeds = t.pages.filter(F.contains("url", F.lit("/es/"))).select("url")
    return ops.link_levels(seeds, page_status(t), page_links(t), 3, allowed_tlds=[".com", ".org"])


@register(
    "c14_website_registry",
    with_roles(
        "search_results",
        v="""SELECT url, created_at AS scraped_at, result_id, CASE WHEN result_id % 3 = 0 THEN '' ELSE
               title || ' ' || strftime(created_at, '%Y%m%d') END AS title FROM search_results""",
        body=f"""SELECT url, {q.netloc('url')} AS domain, count(*) AS scrape_count,
                   strftime(max(scraped_at), '%Y-%m-%d') AS last_scraped, arg_max(nullif(title, ''), CASE WHEN title <> '' THEN scraped_at END)
                     AS title FROM v GROUP BY url""",
    ),
)
def c14(t):
    visits = t.search_results.select(
        "url", F.col("created_at").alias("scraped_at"),
        F.when(F.col("result_id") % 3 == 0, "").otherwise(F.concat("title", F.lit(" "), F.date_format("created_at", "yyyyMMdd"))).alias("title"),
        F.lit(None).cast("string").alias("meta_description"),
    )
    found = ops.website_registry(visits)
    return found.select("url", "domain", "scrape_count", F.date_format("last_scraped_at", "yyyy-MM-dd").alias("last_scraped"), "title")
