"""Job and session level aggregates of keywords and entities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions.skew import top_n as best_rows


def job_keywords(keywords: DataFrame, contents: DataFrame, top_n: int | None = None, keys=("job_id",)) -> DataFrame:
    """Per job and lemma: summed frequency, mean score, contents; the ``top_n`` by frequency of each job."""
    joined = keywords.join(contents.select("content_id", *keys), "content_id")
    out = joined.groupBy(*keys, "lemma").agg(
        F.min("word").alias("word"),
        F.sum("frequency").alias("total_frequency"),
        F.avg("tfidf_score").alias("avg_tfidf"),
        F.count_distinct("content_id").alias("n_contents"),
    )
    return _best(out, keys, [F.desc("total_frequency"), F.col("lemma")], top_n)


def job_entities(entities: DataFrame, contents: DataFrame, top_n: int | None = None, keys=("job_id",)) -> DataFrame:
    """Per job, text and label: rows and contents; the ``top_n`` by rows of each job."""
    joined = entities.join(contents.select("content_id", *keys), "content_id")
    out = joined.groupBy(*keys, "text", "label").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("content_id").alias("n_contents")
    )
    return _best(out, keys, [F.desc("n_rows"), F.col("text"), F.col("label")], top_n)


def _best(df: DataFrame, keys, order, top_n):
    return best_rows(df, list(keys), order, top_n) if top_n else df


def label_counts(entities: DataFrame, contents: DataFrame) -> DataFrame:
    """Entity rows per job and label. Counted per content first, so the join moves counts."""
    per_content = entities.groupBy("content_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return (
        per_content.join(contents.select("content_id", "job_id"), "content_id")
        .groupBy("job_id", "label")
        .agg(F.sum("n").alias("n_entities"))
    )


def analysis_statistics(contents: DataFrame, analyses: DataFrame) -> DataFrame:
    """Per job: contents, analysed contents, failed analyses."""
    state = analyses.select("content_id", F.col("status").alias("analysis_status"))
    return (
        contents.select("content_id", "job_id")
        .join(state, "content_id", "left")
        .groupBy("job_id")
        .agg(
            F.count(F.lit(1)).alias("n_contents"),
            F.count_if(F.col("analysis_status") == "completed").alias("n_analyzed"),
            F.count_if(F.col("analysis_status") == "failed").alias("n_failed"),
        )
    )


def session_keywords(keywords: DataFrame, contents: DataFrame, jobs: DataFrame, top_n: int | None = None) -> DataFrame:
    """Per session and lemma: summed frequency, mean score, rows; through content, job and session."""
    sessions = contents.select("content_id", "job_id").join(jobs.select("job_id", "session_id"), "job_id")
    out = (
        keywords.join(sessions.select("content_id", "session_id"), "content_id")
        .groupBy("session_id", "lemma")
        .agg(
            F.sum("frequency").alias("total_frequency"),
            F.avg("tfidf_score").alias("avg_tfidf"),
            F.count(F.lit(1)).alias("n_rows"),
        )
    )
    return _best(out, ["session_id"], [F.desc("total_frequency"), F.col("lemma")], top_n)


def job_report(
    keywords: DataFrame, entities: DataFrame, contents: DataFrame, analyses: DataFrame, top_n: int
) -> DataFrame:
    """Long table (job_id, section, item, value) of a job's top keywords, top entities, labels and status."""
    rows = [
        job_keywords(keywords, contents, top_n).select(
            "job_id", F.lit("keyword").alias("section"), F.col("lemma").alias("item"),
            F.col("total_frequency").alias("value"),
        ),
        job_entities(entities, contents, top_n).select(
            "job_id", F.lit("entity").alias("section"), F.concat_ws("|", "text", "label").alias("item"),
            F.col("n_rows").alias("value"),
        ),
        label_counts(entities, contents).select(
            "job_id", F.lit("label").alias("section"), F.col("label").alias("item"), F.col("n_entities").alias("value")
        ),
    ]
    status = analysis_statistics(contents, analyses).selectExpr(
        "job_id", "stack(3, 'contents', n_contents, 'analyzed', n_analyzed, 'failed', n_failed) AS (item, value)"
    )
    rows.append(status.select("job_id", F.lit("status").alias("section"), "item", "value"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def replace_results(existing: DataFrame, fresh: DataFrame, key: str = "content_id") -> DataFrame:
    """Rows of ``existing`` for contents that were not analysed again, plus all ``fresh`` rows."""
    redone = fresh.select(key).distinct()
    return existing.join(redone, key, "left_anti").unionByName(fresh)
