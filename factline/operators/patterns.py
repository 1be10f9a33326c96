"""Ordered event patterns: chains of three facts by time-constrained joins, and their discovery."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factline.functions.names import chain_name, chain_validity

#: The pattern catalogue: name, three relations, validity in days, and whether the last fact goes to another entity
#: (fixed values).
CATALOGUE = (
    ("diplomatic_cascade", ("Make_statement", "Make_an_appeal_or_request", "Make_a_visit"), 60, False),
    ("conflict_escalation", ("Accuse", "Criticize_or_denounce", "Protest_or_demonstrate"), 30, False),
    ("cooperation_progression", ("Express_intent_to_cooperate", "Engage_in_negotiation", "Sign_formal_agreement"), 180, False),
    ("aid_commitment", ("Express_intent_to_provide_aid", "Provide_economic_aid", "Cooperate_on_economic_issues"), 90, False),
    ("mediation_treaty", ("Mediate", "Engage_in_negotiation", "Ratify_treaty"), 365, False),
    ("apology_visit_cooperation", ("Apologize", "Make_a_visit", "Engage_in_diplomatic_cooperation"), 90, True),
)


def _role(facts: DataFrame, relation: str, name: str) -> DataFrame:
    return facts.where(F.col("relation") == relation).select(*[F.col(c).alias(f"{name}_{c}") for c in ("row_id", "subject", "object", "day")])


def _near(df: DataFrame, day: str, within: int) -> DataFrame:
    """`df` twice, with the bucket of `within` days that holds `day` and with the next one: what lies at most `within`
    days later is in one of them."""
    bucket = F.floor(F.col(day) / max(1, within))
    return df.withColumn("bucket", F.explode(F.array(bucket, bucket + 1)))


def same_pair(facts: DataFrame, chain: tuple[str, str, str], within: int | None = None, strict: bool = False, distinct_events: bool = False) -> DataFrame:
    """(subject, object, t1, t2, t3, rows): facts of one subject and object in time order.

    Equal days are allowed unless `strict`; `within` bounds t3 - t1 in days; `distinct_events` keeps one fact from
    filling two roles when relations repeat. With `within`, facts meet by pair and time bucket, so a pair that is busy
    for years makes no pairs of far facts, and its facts are spread over buckets; both joins are of facts as they are
    read, so adaptive execution can split what one bucket still holds too much of.
    """
    a, b, c = (_role(facts, r, n) for r, n in zip(chain, "abc"))
    after = (lambda x, y: F.col(f"{x}_day") < F.col(f"{y}_day")) if strict else (lambda x, y: F.col(f"{x}_day") <= F.col(f"{y}_day"))
    pair = lambda x, y: (F.col(f"{x}_subject") == F.col(f"{y}_subject")) & (F.col(f"{x}_object") == F.col(f"{y}_object"))
    if within is None:
        out = a.join(b, pair("a", "b") & after("a", "b")).join(c, pair("a", "c") & after("b", "c"))
    else:
        at = lambda x: F.col("bucket") == F.floor(F.col(f"{x}_day") / max(1, within))
        near = lambda x: F.col(f"{x}_day") - F.col("a_day") <= within
        out = _near(a, "a_day", within).join(b, pair("a", "b") & at("b") & after("a", "b") & near("b")).drop("bucket")
        out = _near(out, "a_day", within).join(c, pair("a", "c") & at("c") & after("b", "c") & near("c"))
    if distinct_events:
        out = out.where("a_row_id <> b_row_id and b_row_id <> c_row_id and a_row_id <> c_row_id")
    return out.select(F.col("a_subject").alias("subject"), F.col("a_object").alias("object"), F.col("a_day").alias("t1"), F.col("b_day").alias("t2"), F.col("c_day").alias("t3"), F.col("a_row_id").alias("row1"), F.col("b_row_id").alias("row2"), F.col("c_row_id").alias("row3"))


def cross_entity(facts: DataFrame, chain: tuple[str, str, str]) -> DataFrame:
    """(subject, object, intermediate, t1, t2, t3): (s, r1, o), (s, r2, m), (m, r3, o) in time order."""
    a, b, c = (_role(facts, r, n) for r, n in zip(chain, "abc"))
    out = a.join(b, (F.col("a_subject") == F.col("b_subject")) & (F.col("a_day") <= F.col("b_day")))
    out = out.join(c, (F.col("b_object") == F.col("c_subject")) & (F.col("a_object") == F.col("c_object")) & (F.col("b_day") <= F.col("c_day")))
    return out.select(F.col("a_subject").alias("subject"), F.col("a_object").alias("object"), F.col("b_object").alias("intermediate"), F.col("a_day").alias("t1"), F.col("b_day").alias("t2"), F.col("c_day").alias("t3"), F.col("a_row_id").alias("row1"), F.col("b_row_id").alias("row2"), F.col("c_row_id").alias("row3"))


def first_matches(facts: DataFrame, chain: tuple[str, str, str], most: int = 100) -> DataFrame:
    """same_pair(), one row per (subject, object, t1, t2): that of the third fact which is first in row order; the
    first `most` by time."""
    found = same_pair(facts, chain)
    best = found.groupBy("subject", "object", "t1", "t2").agg(F.min(F.struct("row3", "t3")).alias("x"))
    return best.select("subject", "object", "t1", "t2", "x.t3").orderBy("t1", "t2", "subject", "object").limit(most)


def object_chain(facts: DataFrame, chain: tuple[str, ...], per_prefix: int | None = None) -> DataFrame:
    """(path): facts joined object to subject in time order; of each prefix the first `per_prefix` continuations."""
    step = lambda r: facts.where(F.col("relation") == r).select("subject", "object", "day", "row_id", F.struct("subject", "relation", "object", "day", "row_id").alias("fact"))
    paths = step(chain[0]).select("object", "day", F.array("fact").alias("path"))
    for r in chain[1:]:
        nxt = step(r).select(F.col("subject").alias("n_subject"), F.col("object").alias("n_object"), F.col("day").alias("n_day"), "fact")
        paths = paths.join(nxt, (F.col("object") == F.col("n_subject")) & (F.col("day") <= F.col("n_day")))
        if per_prefix is not None:
            rank = F.row_number().over(Window.partitionBy("path").orderBy("n_day", "fact.row_id"))
            paths = paths.withColumn("rank", rank).where(F.col("rank") <= per_prefix)
        paths = paths.select(F.col("n_object").alias("object"), F.col("n_day").alias("day"), F.concat("path", F.array("fact")).alias("path"))
    return paths.select("path")


def discover(facts: DataFrame, top: int = 6) -> DataFrame:
    """(r1, r2, r3, n, mean_span): the most frequent relation triples of consecutive facts of one pair."""
    w = Window.partitionBy("subject", "object").orderBy("day", "row_id")
    led = facts.select("relation", "day", F.lead("relation", 1).over(w).alias("r2"), F.lead("relation", 2).over(w).alias("r3"), F.lead("day", 2).over(w).alias("day3"))
    by = led.where(F.col("r3").isNotNull()).groupBy(F.col("relation").alias("r1"), "r2", "r3").agg(F.count("*").alias("n"), F.avg(F.col("day3") - F.col("day")).alias("mean_span"))
    return by.orderBy(F.desc("n"), "r1", "r2", "r3").limit(top)


def discovered_catalogue(facts: DataFrame, top: int = 6) -> DataFrame:
    """discover() with names and validity in days."""
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "r1", "r2", "r3"))  # `top` rows
    return discover(facts, top).select(chain_name(F.col("r1"), rank).alias("pattern"), "r1", "r2", "r3", "n", chain_validity(F.col("mean_span")).alias("validity_days"))


def match_all(facts: DataFrame, catalogue=CATALOGUE) -> DataFrame:
    """All matches of a catalogue, with the pattern's name and validity."""
    out = None
    for name, chain, days, cross in catalogue:
        found = cross_entity(facts, chain) if cross else same_pair(facts, chain).withColumn("intermediate", F.lit(None).cast("string"))
        found = found.select(F.lit(name).alias("pattern"), "subject", "object", "intermediate", "t1", "t2", "t3", F.lit(days).alias("validity_days"))
        out = found if out is None else out.union(found)
    return out


def save(matches: DataFrame, path: str) -> None:
    """Matches of match_all() as Parquet, a folder per pattern, so that reading one reads its files alone."""
    matches.write.mode("overwrite").partitionBy("pattern").parquet(path)
