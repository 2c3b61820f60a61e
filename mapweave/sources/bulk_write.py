"""Bulk insert, update, upsert and delete as table-to-table jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.functions.skew import first_by


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def update(table: DataFrame, changes: DataFrame, keys: Sequence[str] = ("id",)) -> DataFrame:
    """Rows of ``table`` with the columns of the row of ``changes`` that has the same keys."""
    columns = [c for c in changes.columns if c not in keys]
    renamed = changes.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns], F.lit(True).alias("__hit"))
    joined = table.join(renamed, list(keys), "left")
    return joined.select(
        *[
            F.when(F.col("__hit"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in table.columns
        ]
    )


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``rows`` replace the rows with the same keys; of several new rows the last in ``order`` stays."""
    descending = rows.withColumn("__o", F.struct(*order))
    latest = descending.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), "__o").alias("r")).select("r.*")
    return table.join(latest.select(*keys), list(keys), "left_anti").unionByName(latest.select(*table.columns))


def delete(table: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return table.join(ids.select(key), key, "left_anti")


def first_rows(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of several rows to insert with the same keys, the first in ``order``."""
    return first_by(rows, keys, order)
