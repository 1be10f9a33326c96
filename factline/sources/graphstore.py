"""A graph of facts as bucketed tables, in both directions: look-ups of an entity read one bucket, hops need no shuffle.

Each direction is written once, bucketed by the entity that it leads from and sorted by it within a bucket, so the
statistics of row groups narrow a look-up down further. Hops join the two directions, which have one bucketing: the facts
into an entity with those out of it. The files stand on their own; the session's catalog has to know them as tables for
buckets to be used, which open_graph() sees to.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDES = {"outgoing": "subject", "incoming": "object"}
COLUMNS = ["row_id", "subject", "relation", "object", "ts", "day"]


@dataclass(frozen=True)
class Graph:
    """outgoing: facts bucketed by subject; incoming: the same facts bucketed by object."""

    outgoing: DataFrame
    incoming: DataFrame


def _table(name: str, side: str) -> str:
    return f"`{name}_{side}`"


def write_graph(facts: DataFrame, path: str, name: str, buckets: int = 64) -> Graph:
    """Write `facts` below `path`, as tables `name`_outgoing and `name`_incoming. buckets: about as many as the cluster
    has cores, or so many that a bucket is some hundred MB."""
    spark = facts.sparkSession
    for side, key in SIDES.items():
        spark.sql(f"DROP TABLE IF EXISTS {_table(name, side)}")
        dealt = facts.select(*COLUMNS).repartition(buckets, key)  # one file a bucket
        dealt.write.mode("overwrite").bucketBy(buckets, key).sortBy(key, "relation", "day").option("path", f"{path}/{side}").saveAsTable(_table(name, side))
    about = spark.createDataFrame([(json.dumps({"buckets": buckets, "schema": facts.select(*COLUMNS).schema.toDDL()}),)], "value string")
    about.coalesce(1).write.mode("overwrite").text(f"{path}/about")
    return _opened(spark, name)


def open_graph(spark: SparkSession, path: str, name: str) -> Graph:
    """The graph that write_graph() has left at `path`, in this session or another."""
    about = json.loads(spark.read.text(f"{path}/about").collect()[0][0])
    for side, key in SIDES.items():
        spark.sql(f"DROP TABLE IF EXISTS {_table(name, side)}")
        spark.sql(f"CREATE TABLE {_table(name, side)} ({about['schema']}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}, relation, day) INTO {about['buckets']} BUCKETS LOCATION '{path}/{side}'")
    return _opened(spark, name)


def _opened(spark: SparkSession, name: str) -> Graph:
    return Graph(*(spark.table(_table(name, side)) for side in SIDES))


def out_edges(graph: Graph, entity: str) -> DataFrame:
    return graph.outgoing.where(F.col("subject") == entity).select("relation", "object", "ts")


def in_edges(graph: Graph, entity: str) -> DataFrame:
    return graph.incoming.where(F.col("object") == entity).select("subject", "relation", "ts")


def hop(graph: Graph, first: str, second: str) -> DataFrame:
    """(row1, row2, subject, via, object): a `first` fact into an entity and a `second` one out of it that is not earlier."""
    a = graph.incoming.where(F.col("relation") == first).select(F.col("row_id").alias("row1"), "subject", F.col("object").alias("via"), F.col("day").alias("a_day"))
    b = graph.outgoing.where(F.col("relation") == second).select(F.col("row_id").alias("row2"), F.col("subject").alias("via"), "object", F.col("day").alias("b_day"))
    return a.join(b, "via").where("a_day <= b_day").select("row1", "row2", "subject", "via", "object")
