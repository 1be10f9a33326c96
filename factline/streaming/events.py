"""Streaming forms: facts from a stream, ordered pairs by a stream-stream join, windowed counts, rules by batch.

Beyond what the batch operators do, these need bounds in time: watermarks say when state may go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def facts_stream(spark: SparkSession, path: str, like: DataFrame, per_trigger: int = 1) -> DataFrame:
    """A stream of facts with the event time `at` from a folder of events files with the schema of `like`."""
    e = spark.readStream.schema(like.schema).option("maxFilesPerTrigger", per_trigger).parquet(path)
    k = F.get_json_object("props", "$.k").cast("long") % 10
    return e.select(F.col("event_id").alias("row_id"), F.concat(F.lit("u"), "user_id").alias("subject"), F.col("event_type").alias("relation"), F.concat(F.lit("u"), k).alias("object"), F.col("ts").cast("timestamp").alias("at"))


def ordered_pairs(facts: DataFrame, first: str, second: str, within: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(subject, object, t1, t2): a `first` fact and a `second` one of the same pair at most `within` later.

    Both sides carry watermarks, so state older than `within` plus `late` is dropped.
    """
    side = lambda r, n: facts.where(F.col("relation") == r).select(F.col("subject").alias(f"{n}_subject"), F.col("object").alias(f"{n}_object"), F.col("at").alias(n)).withWatermark(n, late)
    a, b = side(first, "t1"), side(second, "t2")
    near = (F.col("t2") >= F.col("t1")) & (F.col("t2") <= F.col("t1") + F.expr(f"interval {within}"))
    found = a.join(b, (F.col("t1_subject") == F.col("t2_subject")) & (F.col("t1_object") == F.col("t2_object")) & near)
    return found.select(F.col("t1_subject").alias("subject"), F.col("t1_object").alias("object"), "t1", "t2")


def relation_counts(facts: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, relation, n) per tumbling window, once the watermark has passed it."""
    return facts.withWatermark("at", late).groupBy(F.window("at", window).alias("w"), "relation").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "relation", "n")


def evolve_by_batch(facts: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str):
    """Run `step` (such as scoring rules on the current facts) on each micro-batch; returns the started query."""
    return facts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
