"""Rules kept up to date as facts arrive, from counts that are kept as state and advanced by the new facts.

The confidence of a rule is a sum over pairs (subject, object), so only the pairs that new facts touch are judged again;
its coverage is a sum over windows of consecutive facts, so only the windows that end in new facts are added, for which
the last few old facts are kept; shares and time ranges of relations add up as they are. A step reads the new facts, the
old facts of the pairs they touch, and the counts. Steps must follow each other in the order of (day, row_id).

Each step writes a version of its own below the path, and its facts beside those of earlier steps, so a step that failed
half-way is run again by its number, and a stream's batch that is delivered twice counts once.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.operators import rules as rule_scores
from factline.operators.rules import Rule
from factline.session import durable

FACTS = "row_id long, subject string, relation string, object string, day long"
TABLES = {
    "pairs": "subject string, object string, rule_id long, b long, hb long",
    "ranges": "relation string, n long, lo long, hi long",
    "covered": "rule_id long, b_valid long, b_total long",
    "tail": FACTS,
}


@dataclass(frozen=True)
class State:
    """Counts of `rules` after `step` steps, below `path`."""

    spark: SparkSession
    path: str
    rules: tuple[Rule, ...]
    step: int = 0

    def table(self, name: str) -> DataFrame:
        if self.step == 0:
            return self.spark.createDataFrame([], TABLES[name])
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}/{self.step}")

    def facts(self) -> DataFrame:
        if self.step == 0:
            return self.spark.createDataFrame([], FACTS)
        return self.spark.read.schema(FACTS).parquet(*[f"{self.path}/facts/{k}" for k in range(1, self.step + 1)])


def advance(state: State, new: DataFrame) -> State:
    """The state after the facts `new`, all of them later than those before by (day, row_id)."""
    rules, path, step = list(state.rules), state.path, state.step + 1
    new.select(*[F.col(c.split(" ")[0]) for c in FACTS.split(", ")]).write.mode("overwrite").parquet(f"{path}/facts/{step}")
    new = state.spark.read.schema(FACTS).parquet(f"{path}/facts/{step}")
    tail = state.table("tail")
    place = F.struct("day", "row_id")
    last, first = tail.agg(F.max(place)).collect()[0][0], new.agg(F.min(place)).collect()[0][0]
    if last and first and tuple(first) <= tuple(last):
        raise ValueError(f"facts from {tuple(first)} on come after those up to {tuple(last)}")

    def write(df: DataFrame, name: str) -> None:
        df.write.mode("overwrite").parquet(f"{path}/{name}/{step}")

    touched = durable(new.select("subject", "object").distinct(), "touched")
    again = state.facts().join(touched, ["subject", "object"], "left_semi").unionByName(new)
    kept = state.table("pairs").join(touched, ["subject", "object"], "left_anti")
    write(kept.unionByName(rule_scores.pair_confidences(again, rules).where("b > 0 or hb > 0")), "pairs")
    write(state.table("ranges").unionByName(rule_scores.relation_ranges(new)).groupBy("relation").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "ranges")
    counts = state.table("covered")
    for length in sorted({len(r[1]) for r in rules}):
        # windows that were not visited before begin at the last `length` old facts
        since = tail.orderBy(F.desc("day"), F.desc("row_id")).limit(length).unionByName(new)
        counts = counts.unionByName(rule_scores.coverages(since, [r for r in rules if len(r[1]) == length]).drop("coverage"))
    write(counts.groupBy("rule_id").agg(F.sum("b_valid").alias("b_valid"), F.sum("b_total").alias("b_total")), "covered")
    longest = max(len(r[1]) for r in rules)
    write(tail.unionByName(new).orderBy(F.desc("day"), F.desc("row_id")).limit(longest), "tail")
    return State(state.spark, path, state.rules, step)


def evaluate(state: State) -> DataFrame:
    """rules.evaluate() of all facts so far."""
    rules = list(state.rules)
    ids = state.spark.createDataFrame([(r[0],) for r in rules], "rule_id long")
    summed = state.table("pairs").groupBy("rule_id").agg(F.sum("b").alias("b"), F.sum("hb").alias("hb"))
    confident = ids.join(summed, "rule_id", "left").select("rule_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("b", "hb")])
    covered = ids.join(state.table("covered"), "rule_id", "left").select("rule_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("b_valid", "b_total")])
    covered = covered.withColumn("coverage", F.when(F.col("b_total") > 0, F.col("b_valid") / F.col("b_total")).otherwise(0.0))
    return rule_scores.rated(rules, confident, covered, rule_scores.heuristic_of(state.table("ranges"), rules))


def evolve(state: State) -> DataFrame:
    """rules.evolve() with all facts so far as the current ones."""
    reach = state.table("ranges").select(F.explode(F.array("lo", "hi")).alias("day"))
    return rule_scores.updated(rule_scores.eliminated(evaluate(state)), reach)


def saved(state: State) -> str:
    """The state as text, which opened() takes."""
    return json.dumps({"path": state.path, "rules": state.rules, "step": state.step})


def opened(spark: SparkSession, text: str) -> State:
    told = json.loads(text)
    return State(spark, told["path"], tuple((i, tuple(b), h, v) for i, b, h, v in told["rules"]), told["step"])


def evolve_stream(facts: DataFrame, path: str, rules: tuple[Rule, ...], checkpoint: str, each=None):
    """Advance a state by each micro-batch of a stream of facts; `each` (state) is called after a step. A batch's number
    is its step, so a batch that comes again writes its step again. Returns the started query."""

    def step(batch: DataFrame, number: int) -> None:
        state = advance(State(batch.sparkSession, path, rules, number), batch)
        if each:
            each(state)

    return facts.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
