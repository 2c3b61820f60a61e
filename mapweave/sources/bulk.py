"""Bulk query files: reading, validation, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.sources.csv_rows import RANGE_BYTES, read_rows, row_key

# Columns, engines and defaults of a bulk query file.
COLUMNS = ("query", "framing", "language", "max_results", "date_from", "date_to", "tld_filter", "search_engine")
ENGINES = ("google_custom", "serper", "serpapi_google")
DEFAULTS = {"framing": "neutral", "language": "en", "max_results": 10, "search_engine": "google_custom"}


def read_bulk_csv(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """file, row_number (from 0), row_key and all columns as text; optional columns that a file lacks are null. A file without ``query``
    is an error. Files are read in ranges, line breaks inside quotes included."""
    rows = read_rows(spark, path, COLUMNS, required=("query",), range_bytes=range_bytes)
    return rows.withColumn("row_key", row_key("row_number"))


def validation_errors(validated: DataFrame) -> DataFrame:
    """(file, validation_errors): the messages of every file's bad rows, a map by row key; no row for a valid file."""
    bad = validated.filter(F.size("errors") > 0)
    entry = F.struct("row_number", "row_key", "errors")
    return bad.groupBy("file").agg(F.sort_array(F.collect_list(entry)).alias("bad")).select(
        "file", F.map_from_entries(F.transform("bad", lambda r: F.struct(r["row_key"], r["errors"]))).alias("validation_errors"))


def stored_rows(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """From files to stored rows: the normalised rows of all valid files, and (file, row_count, invalid_rows, validation_status)."""
    checked = validate(read_bulk_csv(spark, path, range_bytes))
    status = validation_status(checked, "file")
    valid = status.filter("validation_status = 'valid'").select("file")
    return normalize(checked.join(valid, "file", "left_semi")).drop("errors"), status


def validate(rows: DataFrame) -> DataFrame:
    """Adds ``errors``, the array of messages of each row."""
    number = F.col("max_results").try_cast("int")
    given = F.col("max_results").isNotNull()
    bad_tlds = F.filter(F.split("tld_filter", r"\|"), lambda x: ~x.startswith("."))
    tld_errors = F.transform(
        bad_tlds, lambda x: F.concat(F.lit("TLD '"), x, F.lit("' must start with a dot (e.g., '.dk')"))
    )
    checks = F.array_compact(
        F.array(
            F.when(F.trim(F.coalesce("query", F.lit(""))) == "", F.lit("Query is required")),
            F.when(given & number.isNull(), F.lit("max_results must be a number")).when(
                ~number.between(1, 100), F.lit("max_results must be between 1 and 100")
            ),
            F.when(
                ~F.lower("search_engine").isin(*ENGINES),
                F.lit("search_engine must be one of: " + ", ".join(ENGINES)),
            ),
        )
    )
    return rows.withColumn("errors", F.concat(checks, F.coalesce(tld_errors, F.array().cast("array<string>"))))


def validation_status(validated: DataFrame, key: str) -> DataFrame:
    """Per file: rows, invalid rows and the status, 'invalid' as soon as one row is."""
    bad = F.count_if(F.size("errors") > 0)
    return validated.groupBy(key).agg(
        F.count(F.lit(1)).alias("row_count"), bad.alias("invalid_rows"),
        F.when(bad > 0, "invalid").otherwise("valid").alias("validation_status"),
    )


def normalize(rows: DataFrame) -> DataFrame:
    """Trimmed rows with defaults, the TLD list split; other columns are kept."""

    def text(name: str):
        return F.trim(F.coalesce(name, F.lit(DEFAULTS[name])))

    return rows.withColumns(
        {
            "query": F.trim("query"),
            "framing": text("framing"),
            "language": text("language"),
            "max_results": F.coalesce(F.col("max_results").try_cast("int"), F.lit(DEFAULTS["max_results"])).cast("bigint"),
            "search_engine": F.lower(text("search_engine")),
            "tld_filter": F.split("tld_filter", r"\|"),
        }
    )
