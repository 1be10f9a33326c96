"""The whole way from facts to ranked answers: mine, rate, prune, reason, fuse, evaluate.

Phases: (1) rules from sampled paths, (2) validity periods, (3) confidence, coverage and priority, (4) pruning on
recent facts, (5) rule side and graph side, verified and fused with a time-dependent weight.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factline.functions.groups import pseudo_vectors
from factline.operators import decisions, embed, graphmodel, lookup, paths, reasoning, rules
from factline.operators.replies import Kept
from factline.session import durable, shared_path


@dataclass(frozen=True)
class Settings:
    """guide, validity, verify: switches for path validation, learned validity periods and verification. provider: the
    text model that takes decisions.py's decisions; "silent" leaves all of them to the formulas."""

    top_relations: int = 3
    heads: int = 3
    hops: int = 2
    least_priority: float = 0.5
    recent_share: float = 0.2
    train_epochs: int = 0
    top: int = 10
    model_path: str | None = None  # where a trained graph side is kept and looked for
    guide: bool = True
    validity: bool = True
    verify: bool = True
    provider: str = "silent"
    replies: str | None = None  # folder where the text model's replies are kept and looked for; None: one per run
    rules_path: str | None = None  # where rated rules are kept and looked for

    def asks(self) -> bool:
        return self.provider != "silent"

    def model(self, spark: SparkSession) -> Kept:
        return Kept(self.provider, self.replies or shared_path(spark, "replies"))


def mine(facts: DataFrame, vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Rules (rule_id, head, body, validity, source_path) of the most frequent relations; a small table."""
    by = facts.groupBy(F.col("relation").alias("target")).agg(F.count("*").alias("n"), F.max("day").alias("target_day"))
    targets = by.orderBy(F.desc("n"), "target").limit(s.top_relations).drop("n")
    found = durable(paths.sample_paths(facts, rules.composite_scores(facts, vectors), targets, s.heads, s.hops), "paths")
    good = paths.validated(found, vectors) if s.guide else found
    if s.guide and s.asks():
        good = durable(decisions.choose_paths(found, good, s.model(facts.sparkSession)), "chosen")
    mined = rules.rules_of_paths(good)
    if not s.validity:
        return mined
    span = good.join(targets, "target").select(F.col("target").alias("relation"), (F.element_at("path", -1)["day"] - F.get("path", F.lit(0))["day"]).alias("span"), (F.col("target_day") - F.element_at("path", -1)["day"]).alias("gap"))
    periods = rules.validity_period(span)
    if s.asks():
        periods = periods.join(decisions.validities(span, s.model(facts.sparkSession)), "relation", "left").withColumn("validity", F.coalesce("judged", "validity"))
    periods = periods.select(F.col("relation").alias("head"), F.col("validity").alias("period"))
    mined = rules.path_spans(mined.join(periods, "head", "left").withColumn("validity", F.coalesce("period", "validity")).drop("period"))
    # a rule holds at least 1.2 times as long as its own path
    return mined.withColumn("validity", F.greatest("validity", 1.2 * F.coalesce("path_span", F.lit(0.0)))).drop("path_span")


def rate(facts: DataFrame, mined: DataFrame, s: Settings = Settings()) -> DataFrame:
    """`mined` with cp, coverage and priority, without the rules that recent facts rule out."""
    listed = [(r["rule_id"], tuple(r["body"]), r["head"], r["validity"]) for r in mined.select("rule_id", "body", "head", "validity").collect()]  # at most top_relations * heads
    if not listed:
        return mined.withColumns({c: F.lit(None).cast("double") for c in ("cp", "coverage", "priority")})
    spans = durable(rules.path_spans(mined).select("rule_id", "path_span"), "path-spans")
    judged = decisions.confidences(facts, mined, s.model(facts.sparkSession)) if s.asks() else None
    scored = durable(rules.evaluate(facts, listed, judged), "rules")
    ends = facts.agg(F.max("day").alias("hi"), F.min("day").alias("lo"))
    recent = facts.join(ends).where(F.col("day") >= F.col("hi") - s.recent_share * (F.col("hi") - F.col("lo"))).select(*facts.columns)
    evolved = durable(rules.evolve(facts, recent, listed, spans), "evolved")
    if s.asks():
        reach = recent.agg(F.coalesce(F.max("day") - F.min("day"), F.lit(0))).collect()[0][0]
        said = decisions.outliving(evolved, float(reach), s.model(facts.sparkSession)).withColumnRenamed("retained", "said")
        evolved = evolved.join(said, "rule_id", "left").withColumn("retained", F.coalesce("said", "retained")).withColumn("validity", F.coalesce("judged_validity", "validity"))
    kept = evolved.where("retained").select("rule_id", F.col("validity").alias("evolved"))
    return mined.drop("validity").join(scored.select("rule_id", "cp", "coverage", "priority", "validity"), "rule_id").join(kept, "rule_id", "left").withColumn("retained", F.col("evolved").isNotNull()).withColumn("validity", F.coalesce("evolved", "validity")).drop("evolved")


def answer(facts: DataFrame, queries: DataFrame, ruled: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(query_id, entity, score, rank) for queries (query_id, subject, relation, day); one plan for all of them.

    Scores of rules are summed and verified per subject and day, graph candidates carry what their question knows, and both
    meet in one shuffle by query (reasoning.fused).
    """
    asked = durable(reasoning.with_out(facts, queries), "questions") if s.verify else queries
    keep = ("subject", "day", "out") if s.verify else ()
    sums = reasoning.rule_sums(facts, queries, ruled, s.hops + 1, s.least_priority)
    if s.train_epochs:
        model = graphmodel.load(facts.sparkSession, s.model_path) if s.model_path else None
        if model is None:
            model, _ = graphmodel.train(facts, graphmodel.start(facts), s.train_epochs)
            if s.model_path:
                graphmodel.save(model, s.model_path)
        graph_side = graphmodel.graph_scores(facts, model, asked, keep=keep)
    else:
        graph_side = embed.graph_scores(embed.message_layer(facts, embed.entity_vectors(facts)), asked, keep=keep)
    sums = reasoning.rule_factors(sums, ruled) if s.verify else sums.withColumn("factor", F.lit(1.0))
    rule_side = queries.select("query_id", "subject", "day").join(sums, ["subject", "day"])
    if s.verify:
        graph_side = durable(graph_side, "graph-side")
        plain, direct = reasoning.paths_to(facts, graph_side)
        factor = reasoning.matching(ruled)
        rows = reasoning.told(plain, reasoning.GRAPH, factor).union(reasoning.told(direct, reasoning.DIRECT, factor))
    else:
        rows = reasoning.told(graph_side, reasoning.GRAPH)
    if s.verify and s.asks():
        rule_side = durable(rule_side, "rule-side")
        missing = lookup.missing_relations(facts, queries, ruled)
        said = decisions.adjusted(rule_side.select("query_id", "entity", "score"), decisions.rule_context(queries, missing), s.model(facts.sparkSession))
        window = lookup.context_window(facts, queries)
        more = decisions.adjusted(graph_side.select("query_id", "entity", "score"), decisions.graph_context(queries, window, ruled), s.model(facts.sparkSession))
        rows = rows.union(reasoning.told(said, reasoning.RULE_SAID)).union(reasoning.told(more, reasoning.GRAPH_SAID))
    fused = reasoning.fused(rows.union(reasoning.told(rule_side, reasoning.RULE, F.col("factor"))), s.verify)
    weights = reasoning.mean_distances(facts, queries).select("query_id", reasoning.alpha(F.col("dr"), F.col("dg")).alias("alpha"))
    # a question without any candidate could answer any entity but its subject; only `top` are ranked, the most frequent
    names = facts.select(F.col("object").alias("entity"), F.lit(1).alias("n")).union(facts.select("subject", F.lit(0)))
    known = names.groupBy("entity").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "entity").limit(s.top + 1)
    known = known.agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "entity"))).alias("known"))  # one row
    both = queries.select("query_id", "subject").join(weights, "query_id").join(fused, "query_id", "left")
    both = both.select("query_id", "subject", "entity", reasoning.weighed(F.col("alpha")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entity")).cast("long")
    best = both.withColumn("rank", rank).where(F.col("rank") <= s.top).join(F.broadcast(known))
    others = F.filter("known", lambda x: x["entity"] != F.col("subject"))
    bare = F.transform(others, lambda x, i: F.struct(x["entity"].alias("entity"), F.lit(0.0).alias("score"), (i + 1).cast("long").alias("rank")))
    rows = best.select("query_id", F.explode(F.when(F.col("entity").isNull(), bare).otherwise(F.array(F.struct("entity", "score", "rank")))).alias("x"))
    return rows.select("query_id", "x.*").where(F.col("rank") <= s.top)


def rated_rules(facts: DataFrame, vectors: DataFrame, s: Settings = Settings()) -> DataFrame:
    """mine() and rate(); or the rules that an earlier run has left at s.rules_path, and else they are left there."""
    spark = facts.sparkSession
    had = rules.load(spark, s.rules_path) if s.rules_path else None
    if had is not None:
        return had
    ruled = durable(rate(facts, mine(facts, vectors, s), s), "rated")
    if s.rules_path:
        rules.save(ruled, s.rules_path)
    return ruled


def forecast(facts: DataFrame, vectors: DataFrame | None = None, s: Settings = Settings()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, ranked answers, metrics) with the test split as questions and the facts before it as history."""
    s = replace(s, replies=s.model(facts.sparkSession).path) if s.asks() else s
    split = durable(lookup.time_split(facts), "split")
    past = split.where("split <> 'test'").select(*facts.columns)
    questions = split.where("split = 'test'").select(F.col("row_id").alias("query_id"), "subject", "relation", "object", "day")
    ruled = rated_rules(past, pseudo_vectors(past) if vectors is None else vectors, s)
    ranked = durable(answer(past, questions.drop("object"), ruled, s), "ranked")
    return ruled, ranked, reasoning.metrics(ranked, questions.select("query_id", "object"))


MEASURES = ("mrr", "hit1", "hit3", "hit10")


def stability(facts: DataFrame, settings: dict[str, Settings], questions: int | None = None, repeats: int = 1, seed: int = 42) -> DataFrame:
    """(settings, repeats, queries, mean and spread of mrr, hit1, hit3 and hit10): how settings compare, and how much
    draws of `questions` test facts (all, if None) differ over `repeats` draws. Settings answer the same draws. Rules are
    mined once for all settings that differ in verification, fusion and training only."""
    split = durable(lookup.time_split(facts), "split")
    past = split.where("split <> 'test'").select(*facts.columns)
    vectors = durable(pseudo_vectors(past), "vectors")
    draws = []
    for k in range(repeats):
        test = split.where("split = 'test'").select(F.col("row_id").alias("query_id"), "subject", "relation", "object", "day")
        draws.append(durable(test if questions is None else lookup.sampled_questions(split, questions, seed + k), "drawn"))
    mined: dict[tuple, DataFrame] = {}
    rows = None
    for name, s in settings.items():
        s = replace(s, replies=s.model(facts.sparkSession).path) if s.asks() else s
        key = (s.top_relations, s.heads, s.hops, s.recent_share, s.guide, s.validity, s.provider, s.rules_path)
        if key not in mined:
            mined[key] = rated_rules(past, vectors, s)
        for k, drawn in enumerate(draws):
            ranked = durable(answer(past, drawn.drop("object"), mined[key], s), "ranked")
            row = reasoning.metrics(ranked, drawn.select("query_id", "object")).select(F.lit(name).alias("settings"), F.lit(k).alias("repeat"), "*")
            rows = row if rows is None else rows.union(row)
    spread = [x for m in MEASURES for x in (F.round(F.avg(m), 6).alias(m), F.round(F.coalesce(F.stddev_samp(m), F.lit(0.0)), 6).alias(f"{m}_spread"))]
    return rows.groupBy("settings").agg(F.count("*").alias("repeats"), F.sum("queries").alias("queries"), *spread)
