"""Sampled relation paths. All draws come from md5 of a seed and a key, so reruns and other engines agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.functions.names import cosine
from factline.functions.temporal import decay

SEED = 42


def draw(seed: int, *keys: str | Column) -> Column:
    """A hex string that orders rows at random."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) from draw()."""
    return F.conv(F.substring(draw(seed, *keys), 1, 8), 16, 10).cast("double") / 4294967296.0


def sample(df: DataFrame, n: int, key: str = "row_id", seed: int = SEED) -> DataFrame:
    """n rows without replacement."""
    return df.orderBy(draw(seed, key), key).limit(n)


def sample_per(df: DataFrame, by: list[str], n: int, key: str = "row_id", seed: int = SEED) -> DataFrame:
    """n rows of each group without replacement."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(draw(seed, key), key))
    return df.withColumn("drawn", rank).where(F.col("drawn") <= n).drop("drawn")


def sample_paths(facts: DataFrame, scores: DataFrame, targets: DataFrame, heads: int = 3, hops: int = 2, most_edges: int = 50, best: int = 5, seed: int = SEED) -> DataFrame:
    """(path_id, target, path): from `heads` facts of each target relation before its day, `hops` times a fact of the
    current entity, not before the current day and before the target day, drawn by softmax from the best ones.

    targets: target (relation), target_day. scores: composite_scores(). The first step leaves from the subject of the
    head fact. A hop without any fact is skipped; paths of one fact go.
    """
    f = facts.select(F.struct("subject", "relation", "object", "day", "row_id").alias("fact"), F.col("row_id"), "subject", "relation", "object", "day")
    start = f.join(targets, (F.col("relation") == F.col("target")) & (F.col("day") < F.col("target_day")))
    start = sample_per(start, ["target"], heads, seed=seed)
    paths = start.select(F.col("row_id").alias("path_id"), "target", "target_day", F.array("fact").alias("path"), F.col("subject").alias("entity"), F.col("day").alias("at"))
    edges = facts.select(F.col("subject").alias("e_subject"), F.col("relation").alias("e_relation"), F.col("object").alias("e_object"), F.col("day").alias("e_day"), "row_id", F.struct("subject", "relation", "object", "day", "row_id").alias("e_fact"))
    pair = scores.select(F.col("relation_a").alias("s_a"), F.col("relation_b").alias("s_b"), "score").union(scores.where("relation_a <> relation_b").select("relation_b", "relation_a", "score"))
    for hop in range(hops):
        # paths are few, `heads` a target, and go to the facts
        found = F.broadcast(paths).join(edges, (F.col("entity") == F.col("e_subject")) & (F.col("e_day") >= F.col("at")) & (F.col("e_day") < F.col("target_day")))
        found = sample_per(found, ["path_id"], most_edges, seed=seed + hop)
        found = found.join(pair, (F.col("target") == F.col("s_a")) & (F.col("e_relation") == F.col("s_b")))
        found = found.withColumn("worth", F.col("score") * decay(F.col("e_day"), F.col("target_day")))
        order = Window.partitionBy("path_id").orderBy(F.desc("worth"), "row_id")
        found = found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= best)
        group = Window.partitionBy("path_id")
        found = found.withColumn("weight", F.exp(F.col("worth") - F.max("worth").over(group)))
        running = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("weight").over(group)
        found = found.withColumn("upto", running).where(F.col("upto") >= uniform(seed + 100 + hop, "path_id"))
        chosen = found.groupBy("path_id").agg(F.min(F.struct("place", "e_fact", "e_object", "e_day")).alias("x"))
        paths = paths.join(chosen, "path_id", "left").select(
            "path_id", "target", "target_day", F.when(F.col("x").isNull(), F.col("path")).otherwise(F.concat("path", F.array("x.e_fact"))).alias("path"),
            F.coalesce("x.e_object", "entity").alias("entity"), F.coalesce("x.e_day", "at").alias("at"),
        )
    return paths.where(F.size("path") >= 2).select("path_id", "target", "path")


def quality(paths: DataFrame, vectors: DataFrame) -> DataFrame:
    """`paths` with `quality`: 0.5 * mean similarity of neighbouring relations + 0.3 if any gap lies strictly between
    0 and 365 days + 0.2 * distinct entities / twice the length."""
    steps = paths.select("path_id", F.posexplode(F.slice("path", 1, F.size("path") - 1)).alias("i", "x"), "path").select("path_id", F.col("x.relation").alias("a"), F.expr("path[i + 1].relation").alias("b"))
    v = lambda n: vectors.select(F.col("relation").alias(n), F.col("vector").alias(f"v_{n}"))
    coherence = steps.join(v("a"), "a", "left").join(v("b"), "b", "left").groupBy("path_id").agg(F.avg(cosine(F.col("v_a"), F.col("v_b"))).alias("coherence"))
    gap = F.transform(F.slice("path", 2, F.size("path")), lambda x, i: x["day"] - F.get("path", i)["day"])
    smooth = F.when(F.exists(gap, lambda g: (g > 0) & (g < 365)), 1.0).otherwise(0.0)
    entities = F.size(F.array_union(F.transform("path", lambda x: x["subject"]), F.transform("path", lambda x: x["object"])))
    return paths.join(coherence, "path_id").withColumn("quality", 0.5 * F.col("coherence") + 0.3 * smooth + 0.2 * entities / (2 * F.size("path"))).drop("coherence")


def validated(paths: DataFrame, vectors: DataFrame, least: float = 0.3, top: int = 10) -> DataFrame:
    """The `top` paths of each target of sufficient quality."""
    rank = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("quality"), "path_id"))
    return quality(paths, vectors).where(F.col("quality") >= least).withColumn("rank", rank).where(F.col("rank") <= top)
