"""Queries over time."""

from pyspark.sql import functions as F

from mapweave.operators import temporal as ops
from mapweave.plans.registry import register
from mapweave.plans.roles import with_roles

_INDEXED = """SELECT *, dense_rank() OVER (PARTITION BY session_id ORDER BY date_from, date_to) - 1 AS period
              FROM session_results"""


def indexed(t):
    return ops.index_periods(t.session_results)


def overlap_sql(item: str, source: str = "ix", key: str = "session_id") -> str:
    return f"""SELECT '{item}' AS item, a.{key}, a.period, count(*) AS n_items, count(b.{item}) AS overlap,
                 round(count(b.{item}) * 100.0 / count(*), 2) AS percent
               FROM (SELECT DISTINCT {key}, period, {item} FROM {source}) a
               LEFT JOIN (SELECT DISTINCT {key}, period, {item} FROM {source}) b
                 ON a.{key} = b.{key} AND b.period = a.period + 1 AND a.{item} = b.{item}
               WHERE a.period < (SELECT max(period) FROM {source} m WHERE m.{key} = a.{key})
               GROUP BY a.{key}, a.period"""


@register(
    "j1_consecutive_overlap",
    with_roles("session_results", ix=_INDEXED, body=overlap_sql("url") + " UNION ALL " + overlap_sql("domain")),
)
def j1(t):
    source = indexed(t)
    parts = [ops.consecutive_overlap(source, i).withColumn("item", F.lit(i)) for i in ("url", "domain")]
    return parts[0].unionByName(parts[1])


def change_sql(item: str, source: str = "ix", key: str = "session_id") -> str:
    return f"""SELECT {key}, {item}, CASE WHEN bool_or(period = mx) THEN 'new' ELSE 'vanished' END AS change
               FROM (SELECT *, min(period) OVER (PARTITION BY {key}) AS mn, max(period) OVER (PARTITION BY {key}) AS mx
                     FROM {source})
               GROUP BY {key}, {item} HAVING bool_or(period = mx) <> bool_or(period = mn)"""


@register(
    "j2_new_and_vanished",
    with_roles(
        "session_results", ix=_INDEXED, u=change_sql("url"), d=change_sql("domain"),
        body="""SELECT session_id, 'url' AS item, change, count(*) AS n FROM u GROUP BY ALL
                UNION ALL SELECT session_id, 'domain:' || domain, change, 1 FROM d""",
    ),
)
def j2(t):
    source = indexed(t)
    counted = ops.new_and_vanished(source, "url").groupBy("session_id", F.lit("url").alias("item"), "change").agg(
        F.count(F.lit(1)).alias("n")
    )
    listed = ops.new_and_vanished(source, "domain").select(
        "session_id", F.concat(F.lit("domain:"), "domain").alias("item"), "change", F.lit(1).cast("bigint").alias("n")
    )
    return counted.unionByName(listed)


_TOP = """SELECT session_id, period, domain, c, n_results, n_domains, position FROM (
            SELECT *, row_number() OVER (PARTITION BY session_id, period ORDER BY c DESC, domain) AS position,
              CAST(sum(c) OVER (PARTITION BY session_id, period) AS BIGINT) AS n_results,
              count(*) OVER (PARTITION BY session_id, period) AS n_domains
            FROM (SELECT session_id, period, domain, count(*) AS c FROM ix GROUP BY ALL)) WHERE position <= 10"""


@register(
    "j3_period_domains",
    with_roles("session_results", ix=_INDEXED, topd=_TOP, body='SELECT * EXCLUDE (c), c AS "count" FROM topd'),
)
def j3(t):
    return ops.period_domains(indexed(t))


@register(
    "j4_domain_trends",
    with_roles(
        "session_results", ix=_INDEXED, topd=_TOP,
        seen="""SELECT session_id, domain, min(period) AS first, max(period) AS last, count(*) AS appearances,
                  max(c) AS max_count, avg(c) AS avg_count FROM topd GROUP BY ALL""",
        marked="""SELECT *, CASE WHEN first > 0 THEN 'emerging' WHEN last < n_periods - 1 THEN 'declining'
                    WHEN appearances >= n_periods * 0.7 THEN 'stable' END AS trend
                  FROM seen JOIN (SELECT session_id, max(period) + 1 AS n_periods FROM topd GROUP BY 1) USING (session_id)""",
        ranked="""SELECT *, row_number() OVER (PARTITION BY session_id, trend ORDER BY CASE WHEN trend = 'stable'
                    THEN avg_count ELSE max_count END DESC, domain) AS position FROM marked
                  WHERE trend IS NOT NULL AND n_periods >= 2""",
        body="""SELECT session_id, domain, trend, first, last, appearances, max_count, round(avg_count, 6) AS avg_count,
                  position FROM ranked WHERE position <= 10""",
    ),
)
def j4(t):
    found = ops.domain_trends(ops.period_domains(indexed(t)))
    return found.select(
        "session_id", "domain", "trend", "first", "last", "appearances", "max_count",
        F.round("avg_count", 6).alias("avg_count"), "position",
    )


_RANGES = (("1995-01-01", "1997-01-01"), ("1996-06-01", "1999-01-01"), ("1999-01-01", "2002-01-01"))
_RANGE_SQL = " UNION ALL ".join(
    f"""SELECT 0 AS g, {i} AS period, r.url, r.domain FROM session_results r WHERE query_text LIKE 'topic high%'
        AND executed_at >= TIMESTAMP '{a}' AND executed_at < TIMESTAMP '{b}'""" for i, (a, b) in enumerate(_RANGES)
)


@register(
    "j5_compare_periods",
    with_roles(
        "session_results", px=_RANGE_SQL, ov=overlap_sql("url", "px", "g"), ch=change_sql("url", "px", "g"),
        body="""SELECT 'overlap' AS kind, CAST(period AS VARCHAR) AS item, overlap AS n, percent FROM ov
                UNION ALL SELECT 'change', change, count(*), 0.0 FROM ch GROUP BY change""",
    ),
)
def j5(t):
    matching = t.session_results.filter(F.col("query_text").startswith("topic high")).withColumn("g", F.lit(0))
    placed = ops.assign_periods(matching.select("g", "url", "domain", "executed_at"), "executed_at", _RANGES)
    overlap = ops.consecutive_overlap(placed, "url", ["g"]).select(
        F.lit("overlap").alias("kind"), F.col("period").cast("string").alias("item"), F.col("overlap").alias("n"), "percent"
    )
    change = ops.new_and_vanished(placed, "url", ["g"]).groupBy("change").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("change").alias("kind"), F.col("change").alias("item"), "n", F.lit(0.0).alias("percent")
    )
    return overlap.unionByName(change)
