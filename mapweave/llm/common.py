"""Small helpers that several operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapweave.session import checkpoint_root, materialize

__all__ = ["broadcast_model", "cells", "documents", "let", "materialize", "numbered", "release_models", "scratch_path", "slices"]

#: Words are maximal runs of other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_path(spark: SparkSession, kind: str) -> str:
    """A new folder name under the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/mapweave/{kind}-{uuid.uuid4().hex}"


_HELD: list[Broadcast] = []


def broadcast_model(spark: SparkSession, model: object) -> Broadcast:
    """A model of fixed size for all tasks, until ``release_models``."""
    _HELD.append(spark.sparkContext.broadcast(model))
    return _HELD[-1]


def release_models() -> None:
    """Removes the models that were broadcast: for callers that have written what was made with them."""
    while _HELD:
        _HELD.pop().destroy()


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def slices(array: pa.Array, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of a string array of about ``max_bytes`` each (a longer text stands alone)."""
    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(array).to_pylist()):
        if size and size + (n or 0) > max_bytes:
            yield at, i
            at, size = i, 0
        size += n or 0
    if at < len(array):
        yield at, len(array)


def cells(key: Column, n: int) -> Column:
    """One of ``n`` cells by hash: cuts a hot group into parts of like size."""
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def numbered(df: DataFrame, group: list[str], order: list[str], weight: str | None, cell: str) -> DataFrame:
    """Adds ``before``: rows (or the sum of ``weight``) of the group that come earlier, by (``cell``, ``order``).

    Cells are numbered one by one, and a small table of cell totals carries the sums from cell to cell, so no
    task gets a whole group.
    """
    amount = F.col(weight) if weight else F.lit(1)
    inside = Window.partitionBy(*group, cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*group, cell).agg(F.sum(amount).cast("long").alias("_total"))
    along = Window.partitionBy(*group).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*group, cell, F.coalesce(F.sum("_total").over(along), F.lit(0)).alias("_base"))
    here = df.withColumn("_inside", F.coalesce(F.sum(amount).over(inside), F.lit(0)).cast("long")).alias("l")
    match = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*group, cell]]
    joined = here.join(bases.alias("r"), match)
    return joined.select(*[F.col(f"l.{c}").alias(c) for c in df.columns], (F.col("_inside") + F.col("_base")).alias("before"))
