"""Findings of files as they land: only those that weren't there before."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.session import shared_dir


def unseen(findings: DataFrame, key: str = "fingerprint", at: str = "ts", within: str = "3650 days") -> DataFrame:
    """A stream of findings with each key once. State is a row for each key and leaves with the watermark."""
    return findings.withWatermark(at, within).dropDuplicatesWithinWatermark([key])


def against(findings: DataFrame, baseline: DataFrame, key: str = "fingerprint") -> DataFrame:
    """A stream without the keys of a (static) baseline."""
    return findings.join(baseline.select(key).distinct(), key, "left_anti")


def drained(stream: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what there is and returns what it wrote. Sink and state lie in the shared folder; a batch is
    written once, however often it is tried."""
    spark = stream.sparkSession
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def error_findings(events: DataFrame) -> DataFrame:
    """Error events as findings: (fingerprint, user_id, kind, ts)."""
    kind = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    return events.where("event_type = 'error'").select(F.substring(F.sha2(F.concat_ws("/", F.col("user_id").cast("string"), kind), 256), 1, 16).alias("fingerprint"), "user_id", kind.alias("kind"), F.col("ts").cast("timestamp").alias("ts"))
