"""Bounded samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def labelled_sample(df: DataFrame, label: str, key: str, per_label: int, seed: int = 11) -> list:
    """About ``per_label`` rows of each label (at most 1.5 times as many), picked by a hash of ``key``.

    The counts of labels set the share of each; only the sample itself comes to the driver. Rows without a label are
    left out.
    """
    known = df.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    if not counts:
        return []
    # of equal keys all or none are taken; nulls share one key
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    share = F.lit(0.0)
    for value, n in counts.items():
        share = F.when(F.col(label) == F.lit(value), F.lit(min(1.0, per_label / n))).otherwise(share)
    return known.withColumn("_place", place).where(F.col("_place") < share).orderBy("_place", label).limit(
        int(1.5 * per_label) * len(counts)).collect()
