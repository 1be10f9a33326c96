"""Evaluation of case rules: how often a body is followed by its head, and how the head's object ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factline.operators.order import with_position
from factline.session import durable


IN_ONE_TASK = 100_000  # names that are numbered by a sort in one task; more are put in order by ranges


def body_matches(facts: DataFrame, r1: str, r2: str) -> DataFrame:
    """(subject, object, t1, t2, row1, row2) with t1 < t2."""
    a = facts.where(F.col("relation") == r1).select("subject", "object", F.col("day").alias("t1"), F.col("row_id").alias("row1"))
    b = facts.where(F.col("relation") == r2).select("subject", "object", F.col("day").alias("t2"), F.col("row_id").alias("row2"))
    return a.join(b, ["subject", "object"]).where("t1 < t2")


def self_loop_matches(facts: DataFrame, r1: str) -> DataFrame:
    """Bodies of one fact (s, r1, o, t1), asked for (o, head, o): subject and object are both o."""
    return facts.where(F.col("relation") == r1).select(F.col("object").alias("subject"), "object", F.col("day").alias("t2"), F.col("row_id").alias("row2"))


def body_instances(facts: DataFrame, r1: str, r2: str) -> DataFrame:
    """(subject, object, t2, n): how many of body_matches() end at each day, without forming them: facts are counted per
    pair and day, and a running count says how many r1 facts lie before each day with r2 facts."""
    counted = lambda r: F.count_if(F.col("relation") == r)
    by = facts.where(F.col("relation").isin(r1, r2)).groupBy("subject", "object", "day").agg(counted(r1).alias("n1"), counted(r2).alias("n2"))
    before = Window.partitionBy("subject", "object").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce(F.sum("n1").over(before), F.lit(0)) * F.col("n2")
    return by.select("subject", "object", F.col("day").alias("t2"), n.alias("n")).where("n > 0")


def instances(matches: DataFrame) -> DataFrame:
    """Matches with the same question, (subject, object, t2), and how many they are: they all rank alike."""
    return matches.groupBy("subject", "object", "t2").agg(F.count("*").alias("n"))


def _levels(facts: DataFrame, head: str) -> DataFrame:
    """(subject, object, day, n, least, most): head facts per day; the first of a day's facts is the `least`-th of its
    pair counted from the end, the last the `most`-th. At least j facts follow a day if the j-th from the end does."""
    by = facts.where(F.col("relation") == head).groupBy("subject", "object", "day").agg(F.count("*").alias("n"))
    back = Window.partitionBy("subject", "object").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    most = F.sum("n").over(back)
    return by.select("subject", "object", "day", "n", (most - F.col("n") + 1).alias("least"), most.alias("most"))


def _own(found: DataFrame, levels: DataFrame) -> DataFrame:
    """`found` with `own`: the head facts of its pair after t2."""
    pair = Window.partitionBy("subject", "object").orderBy(F.desc("t2"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    asks = found.select("subject", "object", "t2", "n", F.lit(0).alias("asks"), F.lit(None).cast("long").alias("c"))
    rows = levels.select("subject", "object", F.col("day").alias("t2"), F.lit(None).cast("long").alias("n"), F.lit(1).alias("asks"), F.col("n").alias("c"))
    counted = asks.union(rows).withColumn("own", F.coalesce(F.sum("c").over(pair), F.lit(0)))
    return counted.where("asks = 0").select("subject", "object", "t2", "n", "own")


def ranked(found: DataFrame, facts: DataFrame, head: str) -> DataFrame:
    """instances() with `supported`, whether (subject, head, object) follows t2, and `rank`, the place of the true object
    among the objects of (subject, head, .) after t2: candidates score by count, a true object that is not among them
    one half, ties go by name.

    A candidate scores at least j after t2 if its j-th head fact from the end lies after t2. So the candidates of at
    least that score are a count of such facts by day, a running sum per subject and j, and no question meets the head
    facts one by one. Candidates of one score whose names come first need names as well: names are numbered, facts are
    counted in each of the dyadic ranges of numbers that hold them, and the numbers before the true object's are a few
    such ranges. Rows are the head facts times the binary digits of the number of objects, counted per day before they
    are shuffled; a window has two rows a day at most.
    """
    levels = durable(_levels(facts, head), "levels")
    objects = durable(levels.select("object").distinct(), "objects")
    count = objects.count()
    if count <= IN_ONE_TASK:
        ids = objects.withColumn("id", F.row_number().over(Window.orderBy("object")).cast("long") - 1)
    else:
        ids = durable(with_position(objects, ["object"], "id").select("object", "id"), "object-ids")
    digits = max(count - 1, 0).bit_length()
    asked = durable(_own(found, levels).join(ids, "object", "left"), "asked")
    # (level, range, number): in range r of digit k are the ids whose digits above k are `number`; one range holds all
    ends = levels.join(ids, "object").select("subject", "day", "id", F.explode(F.sequence("least", "most")).alias("level"))
    everywhere = F.struct(F.lit(digits).alias("digit"), F.lit(0).cast("long").alias("number"))
    each = [F.struct(F.lit(k).alias("digit"), F.shiftright("id", k).alias("number")) for k in range(digits)]
    held = ends.select("subject", "day", "level", F.explode(F.array(everywhere, *each)).alias("r")).groupBy("subject", "level", "r", "day").agg(F.count("*").alias("c"))
    # the ids before i: for each digit 1 of i the range with that digit 0 and the same digits above
    before = [F.when(F.shiftright("id", k) % 2 == 1, F.struct(F.lit(k).alias("digit"), (F.shiftright("id", k) - 1).alias("number"))) for k in range(digits)]
    probe = lambda level, r, sign: F.struct(level.alias("level"), r.alias("r"), F.lit(sign).alias("sign"))
    tied = F.filter(F.array(*before), lambda r: r.isNotNull()) if before else F.array()
    own, above = F.col("own"), F.array(probe(F.col("own") + 1, everywhere, 1))
    probes = above
    if before:
        ties = F.flatten(F.transform(tied, lambda r: F.array(probe(own, r, 1), probe(own + 1, r, -1))))
        probes = F.when(own > 0, F.concat(above, ties)).otherwise(above)
    probed = asked.select("subject", "object", "t2", F.explode(probes).alias("p")).select("subject", "object", "t2", "p.*")
    wanted = probed.select("subject", "level", "r", F.col("t2").alias("day")).distinct().select("*", F.lit(0).alias("asks"), F.lit(0).cast("long").alias("c"))
    later = Window.partitionBy("subject", "level", "r").orderBy(F.desc("day"), "asks").rowsBetween(Window.unboundedPreceding, 0)
    found_ = wanted.union(held.select("subject", "level", "r", "day", F.lit(1).alias("asks"), "c")).withColumn("c", F.sum("c").over(later)).where("asks = 0 and c > 0")
    counts = probed.join(found_.select("subject", "level", "r", F.col("day").alias("t2"), "c"), ["subject", "level", "r", "t2"])
    ahead = counts.groupBy("subject", "object", "t2").agg(F.sum(F.col("sign") * F.col("c")).alias("ahead"))
    out = asked.join(ahead, ["subject", "object", "t2"], "left")
    return out.select("subject", "object", "t2", "n", (F.col("own") > 0).alias("supported"), (F.coalesce("ahead", F.lit(0)) + 1).alias("rank"))


def evaluate(facts: DataFrame, found: DataFrame, head: str, unsupported_zero: bool = False, least: int = 5) -> DataFrame:
    """One row: matches, cond_acc, mrr, hit1, hit3, hit10, for body_instances() or instances() of matches. Metrics are null
    below `least` matches.

    unsupported_zero: a question whose head never follows counts 0 instead of its rank.
    """
    each = ranked(found, facts, head)
    worth = F.col("supported") if unsupported_zero else F.lit(True)
    mean = lambda x: F.when(F.sum("n") >= least, F.round(F.sum(F.when(worth, x).otherwise(0.0) * F.col("n")) / F.sum("n"), 6))
    hit = lambda k: mean((F.col("rank") <= k).cast("double")).alias(f"hit{k}")
    accuracy = F.when(F.sum("n") >= least, F.round(F.sum(F.when(F.col("supported"), F.col("n")).otherwise(0)) / F.sum("n"), 6))
    return each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("matches"), accuracy.alias("cond_acc"), mean(1 / F.col("rank")).alias("mrr"), hit(1), hit(3), hit(10))


def relation_search(facts: DataFrame, pattern: str) -> DataFrame:
    """(relation, n) whose name matches a regular expression."""
    return facts.where(F.col("relation").rlike(pattern)).groupBy("relation").agg(F.count("*").alias("n"))


def existing(facts: DataFrame, relations: list[str]) -> DataFrame:
    """(relation, n) for each asked relation, 0 where it does not occur."""
    asked = facts.sparkSession.createDataFrame([(r,) for r in relations], "relation string")
    return asked.join(facts.groupBy("relation").agg(F.count("*").alias("c")), "relation", "left").select("relation", F.coalesce("c", F.lit(0)).alias("n"))
