"""Building blocks that keep one hot key from ending up in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def split_row_number(
    df: DataFrame, keys: Sequence[str], coarse: Sequence[str], order: Sequence, name: str
) -> DataFrame:
    """``row_number() over (partition by keys order by coarse, order)`` in two levels.

    Rows are numbered inside (keys, coarse) and shifted by the number of rows of the
    same key with smaller ``coarse``. The shift comes from a grouped count, so a key
    that holds a third of all rows is spread over its ``coarse`` values.
    """
    keys, coarse = list(keys), list(coarse)
    before = W.partitionBy(*keys).orderBy(*coarse).rowsBetween(W.unboundedPreceding, -1)
    shifts = (
        df.groupBy(*keys, *coarse)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, *coarse, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    )
    inner = W.partitionBy(*keys, *coarse).orderBy(*order)
    return (
        df.withColumn("__pos", F.row_number().over(inner))
        .join(shifts, [*keys, *coarse])
        .withColumn(name, (F.col("__pos") + F.col("__shift")).cast("bigint"))
        .drop("__pos", "__shift")
    )


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence, n: int, name: str | None = None) -> DataFrame:
    """First ``n`` rows of every key in ``order`` (a total order).

    Written as ``row_number <= n``: Spark then limits each group before the shuffle
    (WindowGroupLimit), so a hot key sends at most ``n`` rows per task.
    """
    rank = name or "__rn"
    out = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(
        F.col(rank) <= n
    )
    return out.withColumn(rank, F.col(rank).cast("bigint")) if name else out.drop(rank)


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole first row of every key, as an aggregate with map-side combine."""
    picked = F.min_by(F.struct(*df.columns), F.struct(*order))
    return df.groupBy(*keys).agg(picked.alias("__row")).select("__row.*")
