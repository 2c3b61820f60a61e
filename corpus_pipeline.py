"""A corpus pipeline: toxic documents go, one document of each group of near copies stays, personal data is taken out, sources
are mixed to target weights, and the mix is packed into windows.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet to the shared checkpoint
folder and reads again as the next stage's ``docs``. All but the last return the columns of ``documents``.

Edge cases, by stage. A null or empty text scores as harmless, is no near copy, has nothing to redact, gives no words to the
mix, so it ends with the mixing stage. Long texts are worked on whole. A null doc_id stays as it is: such rows are near copies only of
each other's texts and go where a document with an id has the same text. Repeated rows of one id and text become one row in
near_copies, whose ties go to the smallest doc_id. A null source is a source of its own, a null lang or n_chars has no say. Labels that are
missing teach nothing; without labels of both kinds nothing is toxic. Empty tables give no rows. Columns that documents has
beside its own pass through all stages but the last, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import mixing, ngramjoin, packing, pii, toxicity
from mapweave.llm.common import documents, materialize, release_models
from mapweave.session import recorded, remove_tables

_Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_left: list[str] = []


def stage(fn: _Stage) -> _Stage:
    """When a stage begins, what the one before has returned is written: the tables and models that it was made of go. The
    first stage begins a run of its own, and leaves those of the last stage of another run, whose result may still be wanted."""

    @wraps(fn)
    def begun(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if fn.__name__ != STAGES[0][1].__name__:
            remove_tables(spark, _left)
            release_models()
        with recorded() as paths:
            found = fn(spark, docs, sf_dir)
        _left[:] = paths
        return found

    return begun


@stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.5; the model is fitted on labelled documents of the given tables."""
    model = toxicity.fit_labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_below(docs, "text", model, 0.5)


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join (five words, 0.8 or more) the document with the smallest doc_id. Documents
    without words are no copies of each other and stay."""
    return ngramjoin.first_of_components(docs, "doc_id", "text", words=5, percent=80)


@stage
def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind, terms that give it away are generalised or removed."""
    clean = pii.sanitise(docs, "doc_id", "text")
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for each document and pass that takes words of it, with those words as text."""
    return mixing.mixed_texts(docs, "doc_id", "source", "text", mixing.repeating_weights).withColumn(
        "n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


@stage
def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as pieces of windows of 2048 tokens."""
    pieces = packing.pack(docs, "doc_id", "text")
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("pii", redact),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: No stage but the last two can be said in SQL; tests hold each against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
