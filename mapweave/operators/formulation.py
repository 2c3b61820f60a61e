"""Formulating search queries from issues and templates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.framings import FRAMINGS, TERM_TRANSLATIONS

PLACEHOLDER = r"\{(\w+)\}"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _framing_table(language: str) -> Column:
    """Templates of a language as a literal array of (framing, number, template)."""
    return F.array(
        *[
            F.struct(F.lit(f).alias("framing"), F.lit(i).alias("number"), F.lit(text).alias("template"))
            for f, texts in FRAMINGS[language].items()
            for i, text in enumerate(texts, start=1)
        ]
    )


def templates_of(language: Column) -> Column:
    """The template array of a row's language; English for an unknown one."""
    out = None
    for code in FRAMINGS:
        if code != "en":
            branch = _framing_table(code)
            out = F.when(language == code, branch) if out is None else out.when(language == code, branch)
    return out.otherwise(_framing_table("en"))


def _filled(template: Column, variables: Sequence[str]) -> Column:
    out = template
    for name in variables:
        value = F.col(name)
        out = F.when(value.isNull(), out).otherwise(F.replace(out, F.lit("{" + name + "}"), value))
    return out


def expand_framings(
    issues: DataFrame, framings: Sequence[str] | None = None, variables: Sequence[str] = ("issue", "location", "year")
) -> DataFrame:
    """One row per issue and template of its language; templates with an unfilled variable are skipped.

    ``issues`` has language and one column per variable. The templates are a small literal exploded within
    each row, so the product with the issues needs no join.
    """
    rows = issues.select("*", F.inline(templates_of(F.col("language"))))
    if framings:
        rows = rows.filter(F.col("framing").isin(*framings))
    return rows.withColumn("query", _filled(F.col("template"), variables)).filter(~F.col("query").rlike(PLACEHOLDER))


def multi_perspective(
    issues: DataFrame, framings: Sequence[str] | None = None, per_framing: int = 10, **options
) -> DataFrame:
    """:func:`expand_framings` with at most ``per_framing`` queries of each issue and framing.

    The number of an expanded query counts the earlier templates of its framing, which the row itself knows.
    """
    rows = issues.withColumn("__templates", templates_of(F.col("language")))
    variables = options.get("variables", ("issue", "location", "year"))
    usable = F.filter(
        F.transform(
            F.col("__templates"),
            lambda t: F.struct(
                t["framing"].alias("framing"), t["number"].alias("number"), _filled(t["template"], variables).alias("query")
            ),
        ),
        lambda t: ~t["query"].rlike(PLACEHOLDER),
    )
    rows = rows.withColumn("__usable", usable)
    placed = rows.select(*issues.columns, F.inline("__usable"), F.col("__usable")).withColumn(
        "position",
        F.size(
            F.filter("__usable", lambda u: (u["framing"] == F.col("framing")) & (u["number"] <= F.col("number")))
        ).cast("bigint"),
    )
    out = placed.filter(F.col("position") <= per_framing).drop("__usable", "number")
    return out.filter(F.col("framing").isin(*framings)) if framings else out


def template_variables(template) -> Column:
    """Distinct placeholder names in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(_col(template), F.lit(PLACEHOLDER), 1))


def missing_variables(template, substitutions) -> Column:
    return F.array_except(template_variables(template), F.map_keys(_col(substitutions)))


def is_valid_template(template, substitutions) -> Column:
    return F.size(missing_variables(template, substitutions)) == 0


def apply_template(template, substitutions) -> Column:
    """Struct (query, error): the filled template, or the names that are missing."""
    template, subs = _col(template), _col(substitutions)
    filled = F.aggregate(
        F.map_entries(subs),
        template,
        lambda text, entry: F.replace(text, F.concat(F.lit("{"), entry["key"], F.lit("}")), entry["value"]),
    )
    missing = F.array_join(F.array_sort(missing_variables(template, subs)), ", ")
    bad = missing != ""
    return F.struct(
        F.when(~bad, filled).alias("query"),
        F.when(bad, F.concat(F.lit("Missing required variables: "), missing)).alias("error"),
    )


def translate(query, source: str, target: str) -> Column:
    """Known issue terms replaced one after the other; unknown language pairs are unchanged."""
    out = _col(query)
    for a, b in TERM_TRANSLATIONS.get((source, target), ()):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def framing_catalogue(issues: DataFrame) -> DataFrame:
    """All templates of each issue's language with the issue filled in and other placeholders kept."""
    rows = issues.select("*", F.inline(templates_of(F.col("language"))))
    return rows.withColumn("query", _filled(F.col("template"), ("issue",)))
