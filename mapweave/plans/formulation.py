"""Query formulation over issues taken from the part names."""

from pyspark.sql import functions as F

from mapweave.functions.framings import FRAMINGS, TERM_TRANSLATIONS
from mapweave.operators import formulation as ops
from mapweave.plans.registry import register

_ISSUES_SQL = """SELECT DISTINCT p_name AS issue, CASE p_partkey % 3 WHEN 0 THEN 'en' WHEN 1 THEN 'da' ELSE 'fr' END AS language,
    CASE WHEN p_size % 2 = 0 THEN lower(p_type) END AS location, CASE WHEN p_size % 3 = 0 THEN CAST(1990 + p_size AS VARCHAR) END
      AS year FROM part"""
_TEMPLATES_SQL = " UNION ALL ".join(
    f"SELECT '{code}' AS lang, '{f}' AS framing, {i} AS number, '{text}' AS template"
    for code, framings in FRAMINGS.items() for f, texts in framings.items() for i, text in enumerate(texts, start=1)
)
_EXPANDED = f"""SELECT i.*, framing, number, template,
    CASE WHEN year IS NULL THEN y ELSE replace(y, '{{year}}', year) END AS query
  FROM (SELECT *, CASE WHEN location IS NULL THEN x ELSE replace(x, '{{location}}', location) END AS y FROM (
    SELECT i.*, t.framing, t.number, t.template, replace(t.template, '{{issue}}', i.issue) AS x
    FROM issues i JOIN templates t ON t.lang = CASE WHEN i.language = 'da' THEN 'da' ELSE 'en' END)) i"""
_WITH = f"""WITH issues AS ({_ISSUES_SQL}), templates AS ({_TEMPLATES_SQL}), filled AS ({_EXPANDED}),
            usable AS (SELECT * FROM filled WHERE NOT regexp_matches(query, '\\{{\\w+\\}}'))"""


def issues(t):
    rest = F.col("p_partkey") % 3
    return t.part.select(
        F.col("p_name").alias("issue"),
        F.when(rest == 0, "en").when(rest == 1, "da").otherwise("fr").alias("language"),
        F.when(F.col("p_size") % 2 == 0, F.lower("p_type")).alias("location"),
        F.when(F.col("p_size") % 3 == 0, (1990 + F.col("p_size")).cast("string")).alias("year"),
    ).distinct()


@register(
    "e1_expand_framing",
    _WITH + """ SELECT issue, language, location, year, framing, query FROM usable
               WHERE framing IN ('activist', 'local', 'temporal')""",
)
def e1(t):
    found = ops.expand_framings(issues(t), ["activist", "local", "temporal"])
    return found.select("issue", "language", "location", "year", "framing", "query")


@register(
    "e2_multi_perspective",
    _WITH + """ SELECT issue, language, location, year, framing, query, position FROM (SELECT *, row_number() OVER (
               PARTITION BY issue, language, location, year, framing ORDER BY number) AS position FROM usable)
               WHERE position <= 10""",
)
def e2(t):
    return ops.multi_perspective(issues(t)).select(
        "issue", "language", "location", "year", "framing", "query", "position"
    )


_CUSTOM_SQL = """SELECT p_partkey, '{issue} ' || p_name || CASE p_size % 3 WHEN 0 THEN ' in {location}'
      WHEN 1 THEN ' {year} {issue}' ELSE '' END AS template, p_brand AS issue,
      CASE WHEN p_size % 2 = 0 THEN p_type END AS location FROM part"""


def custom(t):
    tail = F.when(F.col("p_size") % 3 == 0, " in {location}").when(F.col("p_size") % 3 == 1, " {year} {issue}").otherwise("")
    subs = F.map_filter(
        F.create_map(
            F.lit("issue"), F.col("p_brand"), F.lit("location"), F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
        ),
        lambda k, v: v.isNotNull(),
    )
    return t.part.select(
        "p_partkey", F.concat(F.lit("{issue} "), "p_name", tail).alias("template"), subs.alias("subs")
    )


@register(
    "e3_template_variables",
    f"""SELECT p_partkey, CASE WHEN contains(template, '{{location}}') THEN 'issue,location'
          WHEN contains(template, '{{year}}') THEN 'issue,year' ELSE 'issue' END AS variables FROM ({_CUSTOM_SQL})""",
)
def e3(t):
    return custom(t).select("p_partkey", F.array_join(ops.template_variables("template"), ",").alias("variables"))


@register(
    "e4_apply_template",
    f"""SELECT p_partkey, CASE WHEN e IS NULL THEN replace(replace(template, '{{issue}}', issue), '{{location}}',
            coalesce(location, '')) END AS query, e AS error
        FROM (SELECT *, CASE WHEN contains(template, '{{year}}') THEN 'Missing required variables: year'
                 WHEN contains(template, '{{location}}') AND location IS NULL THEN 'Missing required variables: location' END AS e
              FROM ({_CUSTOM_SQL}))""",
)
def e4(t):
    return custom(t).select("p_partkey", ops.apply_template("template", "subs").alias("r")).select("p_partkey", "r.*")


@register(
    "e5_validate_template",
    f"""SELECT p_partkey, NOT (contains(template, '{{year}}') OR (contains(template, '{{location}}') AND location IS NULL))
          AS is_valid FROM ({_CUSTOM_SQL})""",
)
def e5(t):
    return custom(t).select("p_partkey", ops.is_valid_template("template", "subs").alias("is_valid"))


_SENTENCE_SQL = """SELECT p_partkey, p_name || ' and ' || CASE p_size % 4 WHEN 0 THEN 'climate change' WHEN 1 THEN 'global warming'
                   WHEN 2 THEN 'climate policy and climate science' ELSE 'klimakrise' END AS query FROM part"""


def _fold(x, pairs):
    for a, b in pairs:
        x = f"replace({x}, '{a}', '{b}')"
    return x


@register(
    "e6_translate",
    f"""SELECT p_partkey, {_fold('query', TERM_TRANSLATIONS[('en', 'da')])} AS danish,
          {_fold('query', TERM_TRANSLATIONS[('da', 'en')])} AS english, query AS other FROM ({_SENTENCE_SQL})""",
)
def e6(t):
    kind = F.col("p_size") % 4
    words = (
        F.when(kind == 0, "climate change").when(kind == 1, "global warming")
        .when(kind == 2, "climate policy and climate science").otherwise("klimakrise")
    )
    rows = t.part.select("p_partkey", F.concat("p_name", F.lit(" and "), words).alias("query"))
    return rows.select(
        "p_partkey", ops.translate("query", "en", "da").alias("danish"), ops.translate("query", "da", "en").alias("english"),
        ops.translate("query", "en", "fr").alias("other"),
    )


@register(
    "e7_framing_catalogue",
    _WITH + " SELECT issue, language, location, year, framing, replace(template, '{issue}', issue) AS query FROM filled",
)
def e7(t):
    return ops.framing_catalogue(issues(t)).select("issue", "language", "location", "year", "framing", "query")
