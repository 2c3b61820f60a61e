"""Session comparison queries."""

from itertools import combinations

from pyspark.sql import functions as F

from mapweave.operators import compare as ops
from mapweave.plans import sqlkit as q
from mapweave.plans.registry import register
from mapweave.plans.roles import with_roles

IDS = (1, 2, 3)


def overlap_sql(item: str, ids=IDS, keep=("size", "only", "and", "jaccard", "all", "intersection", "union", "total")) -> str:
    """Statement by set operations on the distinct items of each session."""
    def has(sid):
        return f"has{sid}"

    flags = ", ".join(f"max(CASE WHEN session_id = {s} THEN 1 ELSE 0 END) AS has{s}" for s in ids)
    rows = []

    def add(metric, label, test, value=None):
        if metric in keep:
            expr = value or f"(SELECT count(*) FROM items WHERE {test})"
            rows.append(f"SELECT '{metric}' AS metric, '{label}' AS label, CAST({expr} AS DOUBLE) AS value")

    for s in ids:
        add("size", s, f"{has(s)} = 1")
        add("only", s, " AND ".join(f"{has(o)} = {1 if o == s else 0}" for o in ids))
    for a, b in combinations(ids, 2):
        add("and", f"{a}_{b}", " AND ".join(f"{has(o)} = {1 if o in (a, b) else 0}" for o in ids))
        inter = f"(SELECT count(*) FROM items WHERE {has(a)} = 1 AND {has(b)} = 1)"
        union = f"(SELECT count(*) FROM items WHERE {has(a)} = 1 OR {has(b)} = 1)"
        add("jaccard", f"{a}_{b}", "", f"round({inter} / {union}, 3)")
        add("intersection", f"{a}_{b}", "", inter)
        add("union", f"{a}_{b}", "", union)
    if len(ids) > 2:
        add("all", "", " AND ".join(f"{has(o)} = 1" for o in ids))
    add("total", "", "TRUE")
    listed = ", ".join(map(str, ids))
    return with_roles(
        "session_results",
        items=f"SELECT {item}, {flags} FROM session_results WHERE session_id IN ({listed}) GROUP BY {item}",
        body=" UNION ALL ".join(rows),
    )


@register("i1_url_overlap", overlap_sql("url"))
def i1(t):
    return ops.set_overlap(t.session_results, IDS, "url")


@register("i2_domain_overlap", overlap_sql("domain"))
def i2(t):
    return ops.set_overlap(t.session_results, IDS, "domain")


@register(
    "i3_unique_results",
    with_roles(
        "session_results",
        body="""SELECT url, arg_max(title, result_id) AS title, arg_max(domain, result_id) AS domain,
                  arg_max(rank, result_id) AS rank FROM session_results WHERE session_id IN (1, 2, 3)
                GROUP BY url HAVING min(session_id) = 2 AND max(session_id) = 2""",
    ),
)
def i3(t):
    return ops.unique_results(t.session_results, IDS, 2)


_COMMON_SQL = {
    "last": """SELECT session_id, url, arg_max(rank, result_id) AS rank FROM session_results
               WHERE session_id IN (1, 2, 3) GROUP BY session_id, url""",
    "wide": """SELECT a.url, a.rank AS r1, b.rank AS r2, c.rank AS r3 FROM last a JOIN last b ON a.url = b.url
               AND b.session_id = 2 JOIN last c ON a.url = c.url AND c.session_id = 3 WHERE a.session_id = 1""",
}


@register(
    "i4_rank_differences",
    with_roles(
        "session_results", **_COMMON_SQL,
        body="""SELECT url, CAST(r1 AS VARCHAR) || ',' || CAST(r2 AS VARCHAR) || ',' || CAST(r3 AS VARCHAR) AS ranks,
                  greatest(r1, r2, r3) - least(r1, r2, r3) AS difference FROM wide
                ORDER BY difference DESC, url LIMIT 20""",
    ),
)
def i4(t):
    return ops.rank_differences(t.session_results, IDS)


@register(
    "i4b_rank_correlation",
    with_roles(
        "session_results", **_COMMON_SQL,
        avgs=" UNION ALL ".join(
            f"""SELECT url, {i} AS sid, rank() OVER (ORDER BY r{i}) + (count(*) OVER (PARTITION BY r{i}) - 1) / 2.0 AS a
                FROM wide""" for i in IDS
        ),
        body=" UNION ALL ".join(
            f"""SELECT {a}::BIGINT AS session_a, {b}::BIGINT AS session_b, count(*) AS n,
                  round(corr(x.a, y.a), 3) AS rho FROM avgs x JOIN avgs y ON x.url = y.url
                WHERE x.sid = {a} AND y.sid = {b}""" for a, b in combinations(IDS, 2)
        ),
    ),
)
def i4b(t):
    return ops.rank_correlation(t.session_results, IDS).drop("p_value")


@register("i4c_rank_p_values")
def i4c(t):
    return ops.rank_correlation(t.session_results, IDS)


@register("i5_url_jaccard", overlap_sql("url", (1, 2, 3, 4, 5), ("size", "jaccard", "intersection", "union", "total", "all")))
def i5(t):
    return ops.set_overlap(t.session_results, (1, 2, 3, 4, 5), "url").filter(~F.col("metric").isin("only", "and"))


@register(
    "i6_domain_profile",
    with_roles(
        "session_results",
        c="SELECT session_id, domain, count(*) AS c FROM session_results WHERE session_id IN (1, 2, 3) GROUP BY ALL",
        body="""SELECT session_id, count(*) AS n_domains, CAST(sum(c) AS BIGINT) AS n_results,
                  round(-sum(p * log2(p)), 3) AS entropy
                FROM (SELECT *, c / sum(c) OVER (PARTITION BY session_id) AS p FROM c) GROUP BY session_id""",
    ),
)
def i6(t):
    return ops.domain_profile(t.session_results, IDS)


@register(
    "i6b_domain_sets",
    with_roles(
        "session_results",
        body="""SELECT domain, count(*) AS n_results, count(DISTINCT session_id) AS n_sessions,
                  CASE count(DISTINCT session_id) WHEN 3 THEN 'common' WHEN 1 THEN 'unique' ELSE 'shared' END AS kind
                FROM session_results WHERE session_id IN (1, 2, 3) GROUP BY domain""",
    ),
)
def i6b(t):
    return ops.domain_sets(t.session_results, IDS)


@register(
    "i7_rank_volatility",
    with_roles(
        "session_results",
        body="""SELECT url, count(*) AS appearances, min(rank) AS best, max(rank) AS worst,
                  max(rank) - min(rank) AS volatility FROM session_results WHERE session_id IN (1, 2, 3)
                GROUP BY url HAVING count(*) > 1 ORDER BY volatility DESC, url LIMIT 10""",
    ),
)
def i7(t):
    return ops.rank_volatility(t.session_results, IDS)


@register(
    "i8_session_spheres",
    with_roles(
        "session_results",
        body=f"""SELECT session_id, {q.sphere_case('url', 'sphere')} AS sphere, count(*) AS n_results
                 FROM session_results WHERE session_id IN (1, 2, 3) GROUP BY ALL""",
    ),
)
def i8(t):
    return ops.session_spheres(t.session_results, IDS)


_DISCOURSE_SQL = {
    "pairs": """SELECT DISTINCT session_id, content_id FROM session_results JOIN content_urls USING (url)
                WHERE session_id IN (1, 2, 3)""",
    "every": """SELECT 'keyword' AS kind, session_id, lemma AS term, CAST(sum(frequency) AS BIGINT) AS weight
                FROM extracted_keywords JOIN pairs USING (content_id) GROUP BY ALL
                UNION ALL SELECT 'entity', session_id, text, count(*) FROM mentions JOIN pairs USING (content_id)
                GROUP BY ALL""",
    "best": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY kind, session_id ORDER BY weight DESC, term)
               AS position FROM every) WHERE position <= 20""",
}


@register(
    "i9_discourse",
    with_roles(
        "session_results", "content_urls", "extracted_keywords", "mentions", **_DISCOURSE_SQL,
        body="""SELECT kind, session_id, term, weight, position,
                  count(*) OVER (PARTITION BY kind, term) = 3 AS is_shared FROM best""",
    ),
)
def i9(t):
    pairs = ops.session_contents(t.session_results, t.content_urls, IDS)
    return ops.discourse(pairs, t.extracted_keywords, t.mentions, len(IDS))


def _section(name: str, rows: str) -> str:
    return f"SELECT '{name}' AS section, metric, label, CAST(value AS DOUBLE) AS value FROM ({rows})"


_SPHERES_SQL = f"""SELECT sphere AS metric, CAST(session_id AS VARCHAR) AS label, count(*) AS value FROM (SELECT session_id,
    {q.sphere_case("url", "sphere")} AS sphere FROM chosen) GROUP BY ALL"""
_PROFILE_SQL = """SELECT unnest(['n_domains', 'n_results', 'entropy']) AS metric, CAST(session_id AS VARCHAR) AS label,
    unnest([CAST(count(*) AS DOUBLE), sum(c), round(-sum(p * log2(p)), 3)]) AS value FROM (SELECT *, c / sum(c) OVER (PARTITION BY session_id) AS p
      FROM (SELECT session_id, domain, count(*) AS c FROM chosen GROUP BY ALL)) GROUP BY session_id"""
_SETS_SQL = """SELECT CASE count(DISTINCT session_id) WHEN 3 THEN 'common' WHEN 1 THEN 'unique' ELSE 'shared' END AS metric, domain AS label,
    count(*) AS value FROM chosen GROUP BY domain"""
_VOLATILE_SQL = """SELECT unnest(['appearances', 'best', 'worst', 'volatility']) AS metric, url AS label, unnest([n, lo, hi, hi - lo]) AS value
    FROM (SELECT url, count(*) AS n, min(rank) AS lo, max(rank) AS hi FROM chosen GROUP BY url HAVING count(*) > 1
          ORDER BY max(rank) - min(rank) DESC, url LIMIT 10)"""
_TALK_SQL = """SELECT kind || CASE WHEN count(*) OVER (PARTITION BY kind, term) = 3 THEN ' shared' ELSE '' END AS metric,
    CAST(session_id AS VARCHAR) || ' ' || CAST(position AS VARCHAR) || ' ' || term AS label, weight AS value FROM best"""


def _overlap_part(item: str) -> tuple[str, str]:
    """The statement of ``overlap_sql`` as its common table expressions, named for the item, and its body."""
    ctes, body = overlap_sql(item).split("\nSELECT 'size'", 1)
    return ctes, "SELECT 'size'" + body


_URL_CTES, _URL_BODY = _overlap_part("url")
_DOMAIN_CTES, _DOMAIN_BODY = _overlap_part("domain")


@register(
    "i10_comparison_report",
    with_roles("session_results", "content_urls", "extracted_keywords", "mentions", **_DISCOURSE_SQL,
               chosen="SELECT * FROM session_results WHERE session_id IN (1, 2, 3)",
               body=" UNION ALL ".join([
                   f"SELECT 'urls' AS section, * FROM ({_URL_CTES}\n{_URL_BODY})",
                   f"SELECT 'domains' AS section, * FROM ({_DOMAIN_CTES}\n{_DOMAIN_BODY})",
                   _section("domain_sets", _SETS_SQL), _section("domain_profile", _PROFILE_SQL), _section("rankings", _VOLATILE_SQL),
                   _section("spheres", _SPHERES_SQL), _section("discourse", _TALK_SQL)])),
)
def i10(t):
    return ops.long_report(ops.compare(t.session_results, IDS, "full", t.content_urls, t.extracted_keywords, t.mentions))
