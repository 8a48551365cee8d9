"""Streaming scoring: requests arriving as files are scored as they land.

Stateless: a file source with a fixed schema, the same ``score_requests`` projection
as the batch path, an append-mode sink.  The checkpoint location (under the shared
checkpoint folder) records which files were processed, so a restarted query resumes
without rescoring or skipping requests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from surveylens import schema as S
from surveylens.operators.boost import BoostedStumps
from surveylens.plans.prep import PrepModel
from surveylens.plans.scoring import score_requests
from surveylens.session import scratch_path


def request_stream(spark: SparkSession, path: str, fmt: str = "parquet",
                   max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(S.REQUEST_SCHEMA).format(fmt)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def start_scoring(spark: SparkSession, source: str, sink: str, prep: PrepModel, model: BoostedStumps,
                  fmt: str = "parquet", checkpoint: str | None = None,
                  available_now: bool = False) -> StreamingQuery:
    scored = score_requests(request_stream(spark, source, fmt), prep, model)
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("path", sink)
              .option("checkpointLocation", checkpoint or scratch_path(spark, "stream-ckpt")))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()


def score_available(spark: SparkSession, source: str, prep: PrepModel, model: BoostedStumps,
                    fmt: str = "parquet") -> DataFrame:
    """Run the stream over everything already in ``source`` and return the scored rows."""
    sink = scratch_path(spark, "stream-out")
    q = start_scoring(spark, source, sink, prep, model, fmt, available_now=True)
    q.awaitTermination()
    return spark.read.parquet(sink)
