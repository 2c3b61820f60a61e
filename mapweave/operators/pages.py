"""Page tables: fallback texts, link levels, the website registry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions import pages as pg
from mapweave.functions import urls
from mapweave.functions.skew import first_by
from mapweave.functions.text import word_count
from mapweave.session import materialize


def clean_contents(
    contents: DataFrame, html_col: str = "html", text_col: str = "text", max_bytes: int | None = None, sample: int | None = None
) -> DataFrame:
    """Cleaned html and text; a page whose html and text are both binary fails with nulls.

    ``max_bytes`` and ``sample`` are those of ``pages.clean_text``: whole texts are kept and judged unless they are given.
    """
    cleaned = contents.withColumns({c: pg.clean_text(c, max_bytes, sample) for c in (html_col, text_col)})
    binary = F.contains(html_col, F.lit("[Binary content")) & F.contains(text_col, F.lit("[Binary content"))
    binary = F.coalesce(binary, F.lit(False))
    return cleaned.select(
        *[c for c in contents.columns if c not in (html_col, text_col, "status")],
        F.when(binary, F.lit("failed")).otherwise(F.col("status")).alias("status"),
        F.when(~binary, F.col(html_col)).alias(html_col),
        F.when(~binary, F.col(text_col)).alias(text_col),
    )


def snippet_fallback(contents: DataFrame, results: DataFrame) -> DataFrame:
    """A failed depth-1 page takes the snippet of its first search result as text and counts as success."""
    first = first_by(results.select("url", "title", "description", "result_id"), ["url"], ["result_id"]).select(
        "url", F.col("title").alias("__title"), F.col("description").alias("__text")
    )
    use = (F.col("status") == "failed") & (F.col("depth") == 1) & (F.coalesce("__text", F.lit("")) != "")
    joined = contents.join(first, "url", "left")
    return joined.withColumns(
        {
            "__use": use,
            "text": F.when(use, F.col("__text")).otherwise(F.col("text")),
            "word_count": F.when(use, word_count("__text")).otherwise(F.col("word_count")),
            "title": F.when(use, F.coalesce(F.nullif(F.col("title"), F.lit("")), "__title")).otherwise(F.col("title")),
            "error_message": F.when(
                use, F.concat(F.lit("Used search snippet (original error: "), F.coalesce("error_message", F.lit("None")), F.lit(")"))
            ).otherwise(F.col("error_message")),
            "status": F.when(use, F.lit("success")).otherwise(F.col("status")),
        }
    ).drop("__use", "__title", "__text")


def link_levels(
    seeds: DataFrame,
    pages: DataFrame,
    links: DataFrame,
    depth: int = 3,
    allowed_tlds: Sequence[str] | None = None,
    same_domain: bool = False,
) -> DataFrame:
    """(url, depth, scraped): the URLs visited at every level of a crawl of ``depth`` levels.

    ``seeds`` has url, ``pages`` (url, status), ``links`` (url, link). A level visits the links of all
    successful pages so far except those already scraped; a page that failed may be visited again.
    Each level is one join on the frontier, written to the checkpoint folder.
    """
    if not 1 <= depth <= 3:
        raise ValueError("depth must be 1 to 3")
    good = pages.filter(F.col("status") == "success").select("url").distinct()
    usable = links.select("url", "link")
    if same_domain:
        usable = usable.filter(F.lower(urls.netloc("url")) == F.lower(urls.netloc("link")))
    if allowed_tlds:
        usable = usable.filter(urls.matches_tld(urls.netloc("link"), allowed_tlds))
    flag = good.withColumn("scraped", F.lit(True))

    def visit(frontier: DataFrame, level: int) -> DataFrame:
        return frontier.join(flag, "url", "left").select(
            "url", F.lit(level).cast("bigint").alias("depth"), F.coalesce("scraped", F.lit(False)).alias("scraped")
        )

    visited = materialize(visit(seeds.select("url").distinct(), 1))
    for level in range(2, depth + 1):
        scraped = visited.filter("scraped").select("url")
        found = usable.join(scraped, "url", "left_semi").select(F.col("link").alias("url")).distinct()
        step = visit(found.join(scraped, "url", "left_anti"), level)
        visited = materialize(visited.unionByName(step), replaces=visited)
    return visited


def website_registry(visits: DataFrame) -> DataFrame:
    """One row per URL: visits, last visit, newest title and description that are not empty."""
    newest = lambda c: F.max_by(
        F.nullif(F.col(c), F.lit("")), F.when(F.nullif(F.col(c), F.lit("")).isNotNull(), F.col("scraped_at"))
    )
    return visits.groupBy("url").agg(
        F.count(F.lit(1)).alias("scrape_count"), F.max("scraped_at").alias("last_scraped_at"),
        newest("title").alias("title"), newest("meta_description").alias("meta_description"),
    ).withColumn("domain", urls.netloc("url"))
