from pyspark.sql import functions as F

from factline.streaming import events

DATA = "/root/testdata/sf0.001"


def feed(spark, tmp_path):
    e = spark.read.parquet(f"{DATA}/events.parquet")
    e.where("event_id < 500").coalesce(1).write.parquet(str(tmp_path / "in"))
    return e, events.facts_stream(spark, str(tmp_path / "in"), e)


def test_ordered_pairs_equal_a_batch_join(spark, tmp_path):
    e, stream = feed(spark, tmp_path)
    q = events.ordered_pairs(stream, "click", "view", "20 days", "10 days").writeStream.format("memory").queryName("pairs").start()
    q.processAllAvailable()
    q.stop()
    b = e.where("event_id < 500").select("user_id", (F.get_json_object("props", "$.k").cast("long") % 10).alias("o"), "event_type", F.col("ts").cast("timestamp").alias("at"))
    x, y = b.where("event_type = 'click'").alias("x"), b.where("event_type = 'view'").alias("y")
    want = x.join(y, F.expr("x.user_id = y.user_id and x.o = y.o and y.at between x.at and x.at + interval 20 days")).count()
    assert want > 0 and spark.table("pairs").count() == want


def test_evolution_sees_every_fact(spark, tmp_path):
    _, stream = feed(spark, tmp_path)
    seen = []
    events.evolve_by_batch(stream, lambda df, _: seen.append(df.count()), str(tmp_path / "state")).awaitTermination()
    assert sum(seen) == 500
