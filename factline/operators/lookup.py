"""Filters, vocabulary, profile and splits of facts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.operators.order import with_position
from factline.operators.paths import sample


def matching(facts: DataFrame, subject: str | None = None, relation: str | None = None, object_: str | None = None, ts: str | None = None, before: str | None = None, after: str | None = None, between: tuple[str, str] | None = None) -> DataFrame:
    """Facts that meet all given conditions; before and after are strict, between is closed."""
    conditions: list[Column] = [F.col(c) == v for c, v in (("subject", subject), ("relation", relation), ("object", object_)) if v is not None]
    date = lambda v: F.lit(v).cast("date")
    if ts is not None:
        conditions.append(F.col("ts") == date(ts))
    if before is not None:
        conditions.append(F.col("ts") < date(before))
    if after is not None:
        conditions.append(F.col("ts") > date(after))
    if between is not None:
        conditions.append(F.col("ts").between(date(between[0]), date(between[1])))
    for c in conditions:
        facts = facts.where(c)
    return facts


def out_edges(facts: DataFrame, entity: str) -> DataFrame:
    return facts.where(F.col("subject") == entity).select("relation", "object", "ts")


def in_edges(facts: DataFrame, entity: str) -> DataFrame:
    return facts.where(F.col("object") == entity).select("subject", "relation", "ts")


def history(facts: DataFrame, day: int, fallback: int = 100) -> DataFrame:
    """Facts up to `day`; without any, the first `fallback` in file order. Decided in the plan: one row says whether
    there are any, the rows of the fallback are ranked only among the first ones."""
    past = facts.where(F.col("day") <= day)
    none = past.select(F.lit(1).alias("one")).limit(1).agg((F.count("*") == 0).alias("none"))
    first = facts.orderBy("row_id").limit(fallback).join(F.broadcast(none)).where("none").drop("none")
    return past.unionByName(first)


def valid(facts: DataFrame) -> DataFrame:
    """Facts whose fields are not empty and whose subject is not their object, after trimming."""
    names = ("subject", "relation", "object")
    trimmed = facts.withColumns({c: F.btrim(c) for c in names})
    return trimmed.where(F.expr("subject <> '' and relation <> '' and object <> '' and subject <> object") & F.col("ts").isNotNull())


def clean(facts: DataFrame) -> DataFrame:
    """Valid facts, the first of equal ones."""
    return valid(facts).groupBy("subject", "relation", "object", "ts").agg(F.min("row_id").alias("row_id"))


def context_window(facts: DataFrame, queries: DataFrame, days: int = 90) -> DataFrame:
    """(query_id, fact columns): the facts of a query's subject in the `days` before its day, both ends in."""
    q = queries.select("query_id", F.col("subject").alias("q_subject"), F.col("day").alias("q_day"))
    return q.join(facts, (F.col("q_subject") == F.col("subject")) & F.col("day").between(F.col("q_day") - days, F.col("q_day"))).drop("q_subject")


def missing_relations(facts: DataFrame, queries: DataFrame, rules: DataFrame, days: int = 90, most: int = 5) -> DataFrame:
    """(query_id, relation, rank): body relations of rules for a query's relation that its window lacks."""
    expected = queries.join(rules.select("head", F.explode("body").alias("expected")), F.col("relation") == F.col("head")).select("query_id", "expected").distinct()
    seen = context_window(facts, queries, days).select("query_id", F.col("relation").alias("expected")).distinct()
    lacking = expected.join(seen, ["query_id", "expected"], "left_anti")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("expected"))
    return lacking.select("query_id", F.col("expected").alias("relation"), rank.cast("long").alias("rank")).where(F.col("rank") <= most)


def vocabulary(facts: DataFrame, *columns: str) -> DataFrame:
    """(value, id): ids by position in sorted order; the position comes from a range-partitioned sort."""
    values = facts.select(F.col(columns[0]).alias("value"))
    for c in columns[1:]:
        values = values.union(facts.select(c))
    return with_position(values.distinct(), ["value"]).select("value", F.col("position").alias("id"))


def relation_profile(facts: DataFrame) -> DataFrame:
    """relation, n, share of all facts, first and last day."""
    by = facts.groupBy("relation").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    return by.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy()), 6))


def summary(facts: DataFrame) -> DataFrame:
    entities = facts.select("subject").union(facts.select("object")).distinct().agg(F.count("*").alias("entities"))
    one = facts.agg(F.count("*").alias("facts"), F.countDistinct("relation").alias("relations"), F.countDistinct("ts").alias("times"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return one.join(entities)  # one row each


TAKEN = 200_000  # facts of one day up to which the boundary is taken from a partial sort


def _boundaries(facts: DataFrame, *shares: float) -> list[tuple[int, int] | None]:
    """(day, row_id) of the first fact beyond each share of the facts in time order; None beyond the end. Counts per day
    say on which day it is; only the facts of that day are put in order."""
    by = facts.groupBy("day").agg(F.count("*").alias("n"))
    before = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    days = by.select("day", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    hits = [(F.col("before") <= F.floor(F.col("total") * s)) & (F.col("before") + F.col("n") > F.floor(F.col("total") * s)) for s in shares]
    found = days.withColumn("hits", F.array(*hits)).where(F.exists("hits", lambda x: x)).collect()  # a row per share
    out = []
    for i, share in enumerate(shares):
        row = next((r for r in found if r["hits"][i]), None)
        if row is None:
            out.append(None)
            continue
        day, inside = row["day"], math.floor(row["total"] * share) - row["before"]
        of_day = facts.where(F.col("day") == day).select("row_id")
        if row["n"] <= TAKEN:
            first = of_day.orderBy("row_id").offset(inside).limit(1)
        else:
            first = with_position(of_day, ["row_id"]).where(F.col("position") == inside)
        out.append((day, first.collect()[0]["row_id"]))
    return out


def _from(boundary: tuple[int, int] | None) -> Column:
    if boundary is None:
        return F.lit(False)
    return (F.col("day") > boundary[0]) | ((F.col("day") == boundary[0]) & (F.col("row_id") >= boundary[1]))


def time_split(facts: DataFrame, train: float = 0.8, valid_share: float = 0.1) -> DataFrame:
    """Facts with `split`: train, valid or test, by time order; a comparison with the first facts of valid and of test,
    without a shuffle of the facts."""
    valid, test = _boundaries(facts, train, train + valid_share)
    return facts.withColumn("split", F.when(_from(test), "test").when(_from(valid), "valid").otherwise("train"))


def test_facts(facts: DataFrame, train: float = 0.8, valid_share: float = 0.1) -> DataFrame:
    """The facts that time_split() calls test."""
    return facts.where(_from(*_boundaries(facts, train + valid_share)))


def sampled_questions(split: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """n facts of the test split as questions, drawn by md5, so that reruns agree."""
    test = split.where(F.col("split") == "test").select(F.col("row_id").alias("query_id"), "subject", "relation", "object", "day")
    return sample(test, n, "query_id", seed)


def encoded(facts: DataFrame) -> DataFrame:
    """(row_id, subject_id, relation_id, object_id, day): facts by the ids of vocabulary(); facts with a name that has
    none (a null) go."""
    entities, relations = vocabulary(facts, "subject", "object"), vocabulary(facts, "relation")
    ids = lambda v, c: v.select(F.col("value").alias(c), F.col("id").alias(f"{c}_id"))
    df = facts.join(ids(entities, "subject"), "subject").join(ids(relations, "relation"), "relation").join(ids(entities, "object"), "object")
    return df.select("row_id", "subject_id", "relation_id", "object_id", "day")


def graph_size(facts: DataFrame) -> DataFrame:
    """One row: nodes and edges of the property graph."""
    names = facts.select("subject").union(facts.select("object")).distinct().agg(F.count("*").alias("nodes"))
    return names.join(facts.agg(F.count("*").alias("edges")))  # one row each


#: Entity kinds by name (fixed values).
COUNTRIES = (
    "United_States", "China", "Russia", "South_Korea", "Japan", "India", "Germany", "France", "United_Kingdom", "Iran",
    "Iraq", "Syria", "Egypt", "Saudi_Arabia", "Turkey", "Pakistan", "Afghanistan", "Mexico", "Canada", "Brazil",
    "Australia", "Ukraine", "Poland", "Italy", "Spain",
)
PERSONS = (
    "Barack_Obama", "Xi_Jinping", "Vladimir_Putin", "Park_Geun-hye", "Shinzo_Abe", "Angela_Merkel", "David_Cameron",
    "Narendra_Modi", "Hassan_Rouhani", "Ban_Ki-moon", "John_Kerry",
)
ORGANIZATIONS = ("United_Nations", "European_Union", "NATO", "OPEC", "World_Bank", "IMF", "ASEAN", "WHO", "Red_Cross")
KINDS = dict.fromkeys(COUNTRIES, "Country") | dict.fromkeys(PERSONS, "Person") | dict.fromkeys(ORGANIZATIONS, "Organization")


def entity_types(facts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(name, kind): looked up in `known` (name, kind), else Entity."""
    spark = facts.sparkSession
    known = known if known is not None else spark.createDataFrame(list(KINDS.items()), "name string, kind string")
    names = facts.select(F.col("subject").alias("name")).union(facts.select("object")).distinct()
    return names.join(known, "name", "left").select("name", F.coalesce("kind", F.lit("Entity")).alias("kind"))


def degrees(facts: DataFrame) -> DataFrame:
    """(name, out_degree, in_degree)."""
    ends = facts.select(F.col("subject").alias("name"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(facts.select("object", F.lit(0), F.lit(1)))
    return ends.groupBy("name").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
