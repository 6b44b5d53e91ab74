"""Micro-batch scoring of application records.

A Structured Streaming file source of client application rows is joined
(stream-static, left) with the precomputed history features of the client
feature plan, encoded, scored with a fitted :class:`ScoringModel` and
appended to a sink.  The operator is stateless (no aggregation over the
stream), so it needs no watermark; the sink's checkpoint in the shared
folder makes restarts and executor loss exactly-once for the file sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from riskfold.plans.features import FeaturePlan, encode_application
from riskfold.plans.model import ScoringModel


def application_stream(spark: SparkSession, source_dir: str, schema: T.StructType,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.json(source_dir)


def scored_stream(applications: DataFrame, client_history: DataFrame, plan: FeaturePlan,
                  model: ScoringModel) -> DataFrame:
    """Streaming DataFrame: SK_ID_CURR, probability, score, decision."""
    app = encode_application(applications, plan)
    return model.score(app.join(client_history, "SK_ID_CURR", "left"))


def start_scoring(scored: DataFrame, sink_dir: str, checkpoint_dir: str, once: bool = False) -> StreamingQuery:
    writer = (scored.writeStream.format("parquet").outputMode("append")
              .option("path", sink_dir).option("checkpointLocation", checkpoint_dir))
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")
    return writer.start()
