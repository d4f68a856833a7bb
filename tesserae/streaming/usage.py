"""Token usage by day and model from a stream of model calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CALLS = "call_id string, ts timestamp, model string, input_tokens long, output_tokens long"


def daily_usage(calls: DataFrame, late: str = "1 day") -> DataFrame:
    """Streaming sums per day and model of ``call_id, ts, model, input_tokens, output_tokens``.

    A call counts once, however often it is told within ``late`` of the newest time seen; a call that
    comes later than that is left out.  Nulls count as 0 tokens, a null time as no call.
    """
    once = calls.filter("ts IS NOT NULL").withWatermark("ts", late).dropDuplicatesWithinWatermark(["call_id"])
    tokens = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c)
    sums = once.groupBy(F.window("ts", "1 day"), "model").agg(F.count(F.lit(1)).alias("calls"), tokens("input_tokens"), tokens("output_tokens"))
    return sums.select(F.to_date("window.start").alias("date"), "model", "calls", "input_tokens", "output_tokens")


def write_daily_usage(calls: DataFrame, target: str, checkpoint: str, late: str = "1 day") -> StreamingQuery:
    """Append finished days to Parquet in ``target``, each once.

    A day is finished when a time of ``late`` after its end has been seen.  The checkpoint holds the
    open days: a stream that starts again goes on with them.
    """
    out = daily_usage(calls, late).writeStream.format("parquet").outputMode("append")
    return out.option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_daily_usage(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.schema("date date, model string, calls long, input_tokens long, output_tokens long").parquet(target)
