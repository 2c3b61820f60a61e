"""Named entity tables: filtering, de-duplication, aggregation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions.skew import top_n

#: Entity labels kept by default.
DEFAULT_LABELS = ("PERSON", "ORG", "GPE", "LOC", "DATE", "EVENT", "PRODUCT")


def unique_entities(mentions: DataFrame, labels: Sequence[str] = DEFAULT_LABELS, min_length: int = 2) -> DataFrame:
    """First mention per (document, lower-case text, label) of the chosen labels."""
    kept = mentions.filter(F.col("label").isin(*labels) & (F.length(F.trim("text")) >= min_length))
    return kept.groupBy("content_id", F.lower(F.trim("text")).alias("key"), "label").agg(
        F.min_by(F.trim("text"), "start_pos").alias("text"), F.min("start_pos").alias("start_pos")
    )


def entity_counts(mentions: DataFrame) -> DataFrame:
    """Mentions per document, label and text, without de-duplication."""
    return mentions.groupBy("content_id", "label", F.trim("text").alias("text")).agg(
        F.count(F.lit(1)).alias("n_mentions")
    )


def entities_of_labels(mentions: DataFrame, labels: Sequence[str]) -> DataFrame:
    return mentions.filter(F.col("label").isin(*labels))


def label_groups(mentions: DataFrame, labels: Sequence[str] | None = None) -> DataFrame:
    """One row per label and distinct text with its mentions and documents.

    A label may hold any share of the mentions, so its members stay rows instead of one list.
    """
    chosen = entities_of_labels(mentions, labels) if labels else mentions
    per_document = chosen.groupBy("label", "text", "content_id").agg(F.count(F.lit(1)).alias("n"))
    return per_document.groupBy("label", "text").agg(
        F.sum("n").alias("n_mentions"), F.count(F.lit(1)).alias("n_contents")
    )


def aggregate_mentions(
    mentions: DataFrame,
    threshold: float = 0.85,
    labels: Sequence[str] | None = None,
    max_entities: int = 100,
) -> DataFrame:
    """Entities per document: frequency, best confidence, first spelling and label.

    A missing confidence counts as 1.0. The best ``max_entities`` by confidence are kept.
    """
    confidence = F.coalesce("confidence", F.lit(1.0))
    kept = mentions.filter((confidence >= threshold) & (F.trim("text") != ""))
    if labels:
        kept = entities_of_labels(kept, labels)
    grouped = kept.groupBy("content_id", F.lower(F.trim("text")).alias("key")).agg(
        F.count(F.lit(1)).alias("frequency"),
        F.max(confidence).alias("confidence"),
        F.min_by(F.trim("text"), "start_pos").alias("text"),
        F.min_by("label", "start_pos").alias("label"),
        F.min("start_pos").alias("start_pos"),
    )
    return top_n(grouped, ["content_id"], [F.desc("confidence"), F.col("key")], max_entities, "position")
