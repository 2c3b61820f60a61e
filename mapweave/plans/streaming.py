"""Streaming query: arriving results, de-duplicated per session."""

import uuid

from pyspark.sql import functions as F

from mapweave.plans import sqlkit as q
from mapweave.plans.registry import register
from mapweave.session import run_folder
from mapweave.streaming.dedup import unseen_results

_URL_SQL = "'https://Topic.example.org/' || event_type || '/' || json_extract_string(props, '$.k') || '/'"


@register(
    "s1_streaming_dedup",
    f"""SELECT DISTINCT user_id AS session_id, md5({q.normalized('url')}) AS url_hash FROM (
          SELECT user_id, {_URL_SQL} AS url FROM events)""",
)
def s1(t):
    """Runs the event table through a stream until it is read, and returns what the sink holds."""
    spark = t.spark
    arriving = (
        spark.readStream.schema(t.events.schema).option("pathGlobFilter", "events.parquet").parquet(t.sf_dir)
        .select(
            F.col("user_id").alias("session_id"),
            F.concat(F.lit("https://Topic.example.org/"), "event_type", F.lit("/"), F.get_json_object("props", "$.k"), F.lit("/")).alias("url"),
            F.col("ts").cast("timestamp").alias("created_at"),
        )
    )
    folder = f"{run_folder(spark)}/streams-{uuid.uuid4().hex}"
    running = (
        unseen_results(arriving, delay="40 days")
        .select("session_id", "url_hash")
        .writeStream.format("parquet")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/state")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema("session_id bigint, url_hash string").parquet(f"{folder}/out")
