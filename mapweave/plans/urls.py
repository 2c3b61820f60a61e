"""URL and domain queries."""

from pyspark.sql import functions as F

from mapweave.functions import urls
from mapweave.plans import sqlkit as q
from mapweave.plans.registry import register
from mapweave.plans.roles import with_roles

_LINKS_SQL = "regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)"


@register(
    "b1_domain",
    f"""SELECT page_id, {q.netloc('url')} AS domain,
               CASE WHEN {q.netloc("bare_url")} = '' THEN split_part({q.path("bare_url")}, '/', 1)
                    ELSE {q.netloc("bare_url")} END AS domain_or_segment,
               {q.netloc("bare_url")} AS bare_domain
        FROM (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN regexp_replace(url, '^https?://', '')
                     ELSE url END AS bare_url FROM pages)""",
)
def b1(t):
    bare = F.when(F.col("page_id") % 2 == 0, F.regexp_replace("url", "^https?://", "")).otherwise(F.col("url"))
    return t.pages.select("page_id", "url", bare.alias("bare_url")).select(
        "page_id",
        urls.netloc("url").alias("domain"),
        urls.domain_or_first_segment("bare_url").alias("domain_or_segment"),
        urls.netloc("bare_url").alias("bare_domain"),
    )


@register("b2_normalize_url", f"SELECT page_id, {q.normalized('url')} AS normalized FROM pages")
def b2(t):
    return t.pages.select("page_id", urls.normalize_url("url").alias("normalized"))


@register("b3_url_hash", f"SELECT page_id, md5({q.normalized('url')}) AS url_hash FROM pages")
def b3(t):
    return t.pages.select("page_id", urls.url_hash("url").alias("url_hash"))


_TARGETS = f"SELECT page_id, unnest({_LINKS_SQL}) AS link FROM pages"


def _targets(t):
    return t.pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("link"))


@register(
    "b4_url_validity",
    f"""SELECT page_id, count(*) AS n_links, CAST(sum(CASE WHEN {q.valid_url('link')} THEN 1 ELSE 0 END) AS BIGINT)
               AS n_valid FROM ({_TARGETS}) GROUP BY page_id""",
)
def b4(t):
    return (
        _targets(t)
        .groupBy("page_id")
        .agg(F.count(F.lit(1)).alias("n_links"), F.count_if(urls.is_valid_url("link")).alias("n_valid"))
    )


_BLACK = ["brand1.com", "brand7.org", "spam-farm.example.org"]
_WHITE = ["brand2.com", "*.dk", "*.example.com"]


@register(
    "b5_blacklist",
    with_roles(
        "search_results",
        body=f"""SELECT domain, count(*) AS n FROM search_results
                 WHERE {q.bare('domain')} NOT IN ({q.quoted(_BLACK)}) GROUP BY domain""",
    ),
)
def b5(t):
    kept = t.search_results.filter(~urls.is_blacklisted("domain", _BLACK))
    return kept.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@register(
    "b6_whitelist",
    with_roles(
        "search_results",
        body=f"""SELECT domain, count(*) AS n FROM search_results
                 WHERE {q.bare('domain')} IN ('brand2.com') OR ends_with({q.bare('domain')}, '.dk')
                    OR ends_with({q.bare('domain')}, '.example.com') GROUP BY domain""",
    ),
)
def b6(t):
    kept = t.search_results.filter(urls.is_whitelisted("domain", _WHITE))
    return kept.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


@register(
    "b7_tld_filter",
    f"""SELECT page_id, url FROM pages
        WHERE ends_with(lower({q.netloc('url')}), '.com') OR ends_with(lower({q.netloc('url')}), '.org')""",
)
def b7(t):
    return t.pages.filter(urls.matches_tld(urls.netloc("url"), [".com", ".ORG"])).select("page_id", "url")


@register(
    "b8_excluded_domains",
    f"""SELECT page_id, {q.netloc('url')} AS domain FROM pages
        WHERE NOT (lower({q.netloc('url')}) = 'example.net' OR ends_with(lower({q.netloc('url')}), '.example.net')
                OR lower({q.netloc('url')}) = 'spam-farm.example.org'
                OR ends_with(lower({q.netloc('url')}), '.spam-farm.example.org'))""",
)
def b8(t):
    host = urls.netloc("url")
    return t.pages.filter(~urls.is_excluded(host, ["example.net", "spam-farm.example.org"])).select(
        "page_id", host.alias("domain")
    )


_ABSOLUTE_SQL = f"""SELECT page_id, url, list_transform({_LINKS_SQL},
        lambda x: CASE WHEN starts_with(x, '/') THEN 'https://' || {q.netloc('url')} || x ELSE x END) AS links FROM pages"""


@register(
    "b9_same_domain_links",
    f"""SELECT page_id, CAST(len(list_filter(links, lambda x: lower({q.netloc('x')}) = lower({q.netloc('url')}))) AS BIGINT)
               AS n_same, CAST(len(links) AS BIGINT) AS n_links FROM ({_ABSOLUTE_SQL})""",
)
def b9(t):
    found = F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)
    absolute = F.transform(
        found,
        lambda x: F.when(x.startswith("/"), F.concat(F.lit("https://"), urls.netloc("url"), x)).otherwise(x),
    )
    return t.pages.select("page_id", "url", absolute.alias("links")).select(
        "page_id",
        F.size(urls.same_domain_links("links", "url")).cast("bigint").alias("n_same"),
        F.size("links").cast("bigint").alias("n_links"),
    )


@register(
    "b10_sphere",
    with_roles(
        "search_results",
        body=f"""SELECT DISTINCT url, {q.bare(q.netloc('url'))} AS domain, {q.sphere_case('url', 'sphere')} AS sphere,
                 {q.sphere_case('url', 'confidence')} AS confidence, {q.sphere_case('url', 'method')} AS method
                 FROM (SELECT url FROM search_results UNION ALL SELECT url FROM pages)""",
    ),
)
def b10(t):
    every = t.search_results.select("url").unionByName(t.pages.select("url")).distinct()
    return urls.classify_spheres(every).withColumn("domain", urls.bare_domain(urls.netloc("url")))


@register(
    "b11_filter_results",
    with_roles(
        "search_results",
        body=f"""SELECT result_id, url, domain FROM search_results
                 WHERE url <> '' AND domain <> '' AND {q.valid_url('url')}
                   AND {q.bare('domain')} NOT IN ({q.quoted(_BLACK)})
                   AND (ends_with(domain, '.com') OR ends_with(domain, '.edu') OR ends_with(domain, '.gov'))
                   AND {q.sphere_case('url', 'sphere')} IN ('academia', 'general')""",
    ),
)
def b11(t):
    return urls.filter_results(
        t.search_results, blacklist=_BLACK, tlds=[".com", ".edu", ".gov"], spheres=["academia", "general"]
    ).select("result_id", "url", "domain")


@register(
    "b12_sphere_distribution",
    with_roles(
        "search_results",
        body=f"""SELECT {q.sphere_case('url', 'sphere')} AS sphere, count(*) AS n_results
                 FROM search_results GROUP BY 1""",
    ),
)
def b12(t):
    return urls.sphere_distribution(t.search_results)


@register("b13_node_id", f"SELECT page_id, {q.sanitized("'website_' || url")} AS node_id FROM pages")
def b13(t):
    return t.pages.select("page_id", urls.sanitize_node_id(F.concat(F.lit("website_"), "url")).alias("node_id"))


@register(
    "b14_url_terms",
    f"""SELECT page_id, lower(term) AS term, count(*) AS n FROM (
          SELECT page_id, unnest(string_split_regex(regexp_replace({q.path('url')}, '^/+|/+$', '', 'g'), '[/_-]')) AS term
          FROM pages) WHERE length(term) >= 3 GROUP BY page_id, lower(term)""",
)
def b14(t):
    return (
        t.pages.select("page_id", F.explode(urls.url_terms("url")).alias("term"))
        .groupBy("page_id", "term")
        .agg(F.count(F.lit(1)).alias("n"))
    )
