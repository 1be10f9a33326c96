"""Temporal rules: confidence, coverage, priority, validity, evolution and extraction from paths.

A rule is (rule_id, head, body array<string>, validity in days).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factline.operators import hotpairs
from factline.operators.order import following, with_position
from factline.session import durable

WEIGHT_CONFIDENCE, WEIGHT_COVERAGE = 0.7, 0.3
DEFAULT_VALIDITY = 30
#: Days for which a relation's effect holds; other relations hold DEFAULT_VALIDITY (fixed values).
VALIDITY = {
    "Make_statement": 14, "Make_a_visit": 30, "Consult": 21, "Make_an_appeal_or_request": 14,
    "Express_intent_to_cooperate": 30, "Engage_in_diplomatic_cooperation": 60, "Host_a_visit": 30, "Accuse": 21,
    "Criticize_or_denounce": 14, "Threaten": 30, "Protest_or_demonstrate": 7, "Fight_with_artillery_and_tanks": 7,
    "Use_conventional_military_force": 14, "Provide_aid": 60, "Provide_military_aid": 90, "Provide_economic_aid": 90,
    "Express_intent_to_provide_aid": 30, "Cooperate_on_economic_issues": 90, "Engage_in_negotiation": 45, "Mediate": 60,
    "Sign_formal_agreement": 180, "Ratify_treaty": 365, "Apologize": 14, "Praise_or_endorse": 30, "Meet_with": 7,
    "Discuss_by_telephone": 3,
}
#: Relations whose spans count more, and less (fixed values).
LONG_TERM = ("Sign_formal_agreement", "Ratify_treaty", "Cooperate_on_economic_issues", "Provide_economic_aid", "Provide_military_aid", "Engage_in_diplomatic_cooperation")
SHORT_TERM = ("Meet_with", "Discuss_by_telephone", "Make_statement", "Apologize", "Criticize_or_denounce")


Rule = tuple[int, tuple[str, ...], str, float]  # rule_id, body, head, validity
HOT_PAIR = 1_000_000  # facts of one pair that one window takes
RULES_A_PASS = 8  # window columns of so many rules share one sort


def _passes(rules: list[Rule]) -> list[list[Rule]]:
    by_length = sorted(rules, key=lambda r: len(r[1]))
    return [by_length[i : i + RULES_A_PASS] for i in range(0, len(by_length), RULES_A_PASS)]


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def confidences(facts: DataFrame, rules: list[Rule], hot: int = HOT_PAIR) -> DataFrame:
    """(rule_id, b, hb) of each rule: body matches, and those whose head follows, over all pairs (subject, object).

    Each fact of a pair starts one attempt on the facts from it on. Strict: the body's relations are the next ones
    and the times up to the fact after them span at most `validity`; the head matches if it is that fact. Otherwise
    relaxed: the body as a greedy subsequence whose times span at most `validity`, with the head anywhere from the
    start on. A pair stops at its first match of both.

    Running windows in reverse time order say, for each fact, where the greedy match of the body's end would end, so
    no pair is gathered as an array. All windows of a pass have one order: one shuffle and one sort serve all its rules.
    Pairs of more than `hot` facts, for which one window would be too much, are judged in blocks (hotpairs.py).
    """
    busy = None
    if facts.count() > hot:  # else no pair can be
        by = facts.groupBy("subject", "object").agg(F.count("*").alias("n")).where(F.col("n") > hot)
        busy = durable(by.select("subject", "object"), "hot-pairs")
        busy = busy if busy.limit(1).collect() else None
    if busy is None:
        return _union([_confidences(facts, p) for p in _passes(rules)])
    rest, many = facts.join(busy, ["subject", "object"], "left_anti"), facts.join(busy, ["subject", "object"], "left_semi")
    both = _union([part for p in _passes(rules) for part in (_confidences(rest, p), hotpairs.confidences(many, p))])
    return both.groupBy("rule_id").agg(F.sum("b").alias("b"), F.sum("hb").alias("hb"))


def pair_confidences(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(subject, object, rule_id, b, hb): what each pair has part in confidences(), which is their sum."""
    return _union([_confidences(facts, p, ["subject", "object"]) for p in _passes(rules)])


def _confidences(facts: DataFrame, rules: list[Rule], by: list[str] = []) -> DataFrame:
    pair = Window.partitionBy("subject", "object")
    back = pair.orderBy(F.desc("day"), F.desc("row_id"))
    upto = back.rowsBetween(Window.unboundedPreceding, 0)  # the fact and all later ones
    longest = max(len(r[1]) for r in rules)
    relation, f = F.col("relation"), facts.select("subject", "object", "relation", "day", "row_id")
    f = f.withColumns({f"r{k}": F.lag("relation", k).over(back) for k in range(1, longest + 1)} | {f"d{k}": F.lag("day", k).over(back) for k in range(1, longest + 1)})
    # e: end of the greedy match of the body's last relations, one more in each step, among the facts from here on
    f = f.withColumns({f"e{i}": F.last(F.when(relation == body[-1], F.col("day")), True).over(upto) for i, (_, body, _, _) in enumerate(rules)})
    for step in range(2, longest + 1):
        longer = [(i, body[-step]) for i, (_, body, _, _) in enumerate(rules) if len(body) >= step]
        f = f.withColumns({f"n{i}": F.lag(f"e{i}").over(back) for i, _ in longer})
        f = f.withColumns({f"e{i}": F.last(F.when((relation == r) & F.col(f"n{i}").isNotNull(), F.col(f"n{i}")), True).over(upto) for i, r in longer})
    made = {}
    for i, (_, body, head, _) in enumerate(rules):
        made[f"begin{i}"] = F.last(F.when(relation == body[0], F.col("day")), True).over(upto)
        made[f"later{i}"] = F.max((relation == head).cast("int")).over(upto) == 1
    f = f.withColumns(made)
    made = {}
    for i, (_, body, head, validity) in enumerate(rules):
        strict: Column = (F.col(f"d{len(body)}") - F.col("day") <= validity) & (relation == body[0])
        for k, r in enumerate(body[1:], 1):
            strict = strict & (F.col(f"r{k}") == r)
        strict = F.coalesce(strict, F.lit(False))
        relaxed = F.coalesce(F.col(f"e{i}") - F.col(f"begin{i}") <= validity, F.lit(False))
        made[f"matched{i}"] = strict | relaxed
        made[f"both{i}"] = F.when(strict, F.coalesce(F.col(f"r{len(body)}") == head, F.lit(False))).otherwise(relaxed & F.col(f"later{i}")).cast("int")
    f = f.select("subject", "object", "day", "row_id", *[c.alias(n) for n, c in made.items()])
    # a fact counts while none before it matched both: as many as there are lie from it on
    n = range(len(rules))
    f = f.withColumns({f"open{i}": F.sum(f"both{i}").over(pair) == F.sum(f"both{i}").over(upto) for i in n})
    one = f.groupBy(*by).agg(*[x for i in n for x in (F.count_if(F.col(f"open{i}") & F.col(f"matched{i}")).alias(f"b{i}"), F.count_if(F.col(f"open{i}") & (F.col(f"both{i}") == 1)).alias(f"hb{i}"))])
    each = [F.struct(F.lit(r[0]).cast("long").alias("rule_id"), F.col(f"b{i}").alias("b"), F.col(f"hb{i}").alias("hb")) for i, r in enumerate(rules)]
    return one.select(*by, F.explode(F.array(*each)).alias("x")).select(*by, "x.*")


def confidence(facts: DataFrame, body: tuple[str, ...], head: str, validity: float) -> DataFrame:
    """One row (b, hb), as confidences() of one rule."""
    return confidences(facts, [(0, body, head, validity)]).drop("rule_id")


def _listed(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    return facts.sparkSession.createDataFrame([(i, h, list(b), float(v)) for i, b, h, v in rules], "rule_id long, head string, body array<string>, validity double")


def heuristic_confidences(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, cp): for rules without body matches, from the body relations' shares of all facts and the overlap of
    their time ranges with the head's."""
    return heuristic_of(relation_ranges(facts), rules)


def relation_ranges(facts: DataFrame) -> DataFrame:
    """(relation, n, lo, hi): facts, first and last day of each relation."""
    return facts.groupBy("relation").agg(F.count("*").alias("n"), F.min("day").alias("lo"), F.max("day").alias("hi"))


def heuristic_of(ranges: DataFrame, rules: list[Rule]) -> DataFrame:
    """heuristic_confidences() from relation_ranges()."""
    by = ranges.withColumn("total", F.sum("n").over(Window.partitionBy()))  # a row per relation
    h = by.select(F.col("relation").alias("head"), F.col("lo").alias("h_lo"), F.col("hi").alias("h_hi"))
    each = _listed(ranges, rules).select("rule_id", "head", F.explode("body").alias("relation")).join(by, "relation", "left").join(h, "head", "left")
    overlap = F.greatest(F.lit(0), F.least("hi", "h_hi") - F.greatest("lo", "h_lo"))
    span = F.greatest(F.lit(1), F.greatest("hi", "h_hi") - F.least("lo", "h_lo"))
    time = 0.5 * F.when(F.col("h_lo").isNull(), 0.1).otherwise(F.coalesce(overlap / span, F.lit(0.0)))
    part = 50 * F.coalesce(F.col("n") / F.col("total"), F.lit(0.0)) + time
    return each.groupBy("rule_id").agg((0.3 + 0.4 * F.least(F.lit(1.0), F.avg(part))).alias("cp"))


def heuristic_confidence(facts: DataFrame, body: tuple[str, ...], head: str) -> DataFrame:
    """One row (cp), as heuristic_confidences() of one rule."""
    return heuristic_confidences(facts, [(0, body, head, 0.0)]).drop("rule_id")


def coverages(facts: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule_id, b_valid, b_total, coverage): windows of consecutive facts in the global time order whose relations are
    the body, and those that span at most `validity`. The last window is not visited. Facts are put in order once."""
    longest = max(len(r[1]) for r in rules)
    placed = with_position(facts.select("relation", "day", "row_id"), ["day", "row_id"])
    ahead = {f"r{k}": ("relation", k) for k in range(1, longest)} | {f"d{k}": ("day", k) for k in range(1, longest)}
    led = following(placed, ahead) if ahead else placed
    led = led.join(placed.agg(F.count("*").alias("total")))  # one row

    def counts(i: int, body: tuple[str, ...], validity: float) -> list[Column]:
        same: Column = (F.col("relation") == body[0]) & (F.col("position") < F.col("total") - len(body))
        for k, r in enumerate(body[1:], 1):
            same = same & (F.col(f"r{k}") == r)
        end = F.col(f"d{len(body) - 1}") if len(body) > 1 else F.col("day")
        return [F.count_if(same & (end - F.col("day") <= validity)).alias(f"v{i}"), F.count_if(same).alias(f"t{i}")]

    one = led.agg(*[c for i, (_, body, _, validity) in enumerate(rules) for c in counts(i, body, validity)])
    each = [F.struct(F.lit(r[0]).cast("long").alias("rule_id"), F.col(f"v{i}").alias("b_valid"), F.col(f"t{i}").alias("b_total")) for i, r in enumerate(rules)]
    out = one.select(F.explode(F.array(*each)).alias("x")).select("x.*")
    return out.withColumn("coverage", F.when(F.col("b_total") > 0, F.col("b_valid") / F.col("b_total")).otherwise(0.0))


def coverage(facts: DataFrame, body: tuple[str, ...], validity: float) -> DataFrame:
    """One row (b_valid, b_total, coverage), as coverages() of one rule."""
    return coverages(facts, [(0, body, "", validity)]).drop("rule_id")


def evaluate(facts: DataFrame, rules: list[Rule], judged: DataFrame | None = None) -> DataFrame:
    """rule_id, head, body, validity, b, hb, cp, b_valid, b_total, coverage, priority of each rule, in one sort of the
    facts by pair and one by time for RULES_A_PASS rules.

    A rule without body matches takes its confidence from `judged` (rule_id, judged), where that has one, else from
    heuristic_confidences().
    """
    return rated(rules, confidences(facts, rules), coverages(facts, rules), heuristic_confidences(facts, rules), judged)


def rated(rules: list[Rule], confident: DataFrame, covered: DataFrame, heuristic: DataFrame, judged: DataFrame | None = None) -> DataFrame:
    """evaluate() from what confidences(), coverages() and heuristic_confidences() give."""
    df = _listed(confident, rules).join(confident, "rule_id").join(covered, "rule_id")
    df = df.join(heuristic.withColumnRenamed("cp", "cp_else"), "rule_id")
    if judged is not None:
        df = df.join(judged.select("rule_id", "judged"), "rule_id", "left").withColumn("cp_else", F.coalesce("judged", "cp_else"))
    cp = F.when(F.col("b") > 0, F.col("hb") / F.col("b")).otherwise(F.col("cp_else"))
    out = df.select("rule_id", "head", "body", "validity", "b", "hb", cp.alias("cp"), "b_valid", "b_total", "coverage")
    return out.withColumn("priority", priority(F.col("cp"), F.col("coverage")))


def priority(cp: Column, cover: Column) -> Column:
    return WEIGHT_CONFIDENCE * cp + WEIGHT_COVERAGE * cover


def ranked(rules: DataFrame, least: float = 0.5) -> DataFrame:
    """Rules of sufficient priority with their rank."""
    rank = F.row_number().over(Window.orderBy(F.desc("priority"), "rule_id"))  # a table of rules
    return rules.where(F.col("priority") >= least).withColumn("rank", rank.cast("long"))


def eliminated(rules: DataFrame, least_priority: float = 0.6, least_confidence: float = 0.6) -> DataFrame:
    """`rules` with `retained`: false where both priority and confidence are too low."""
    return rules.withColumn("retained", ~((F.col("priority") < least_priority) & (F.col("cp") < least_confidence)))


def updated(rules: DataFrame, current: DataFrame, path_span: str | None = None) -> DataFrame:
    """`rules` with the validity after one round on `current` facts: the mean with their time span, but at least 1.2
    times the span of the rule's path (column `path_span`, 30 where there is none)."""
    span = current.agg(F.coalesce(F.max("day") - F.min("day"), F.lit(0)).alias("span"))
    own = F.coalesce(F.col(path_span), F.lit(30.0)) if path_span else F.lit(30.0)
    return rules.join(span).withColumn("validity", F.greatest((F.col("validity") + F.col("span")) / 2, 1.2 * own)).drop("span")


def path_spans(rules: DataFrame) -> DataFrame:
    """`rules` with path_span, the days that the facts of a rule's source path span; null without a path."""
    days = F.transform("source_path", lambda x: x["day"])
    return rules.withColumn("path_span", F.when(F.size("source_path") > 0, (F.array_max(days) - F.array_min(days)).cast("double")))


def evolve(facts: DataFrame, current: DataFrame, rules: list[Rule], spans: DataFrame | None = None) -> DataFrame:
    """Re-scored on `current`, eliminated, and given new validities. spans: (rule_id, path_span) of the rules' paths."""
    judged = eliminated(evaluate(current, rules))
    if spans is None:
        return updated(judged, current)
    return updated(judged.join(spans.select("rule_id", "path_span"), "rule_id", "left"), current, "path_span").drop("path_span")


def history_step(judged: DataFrame, step: int) -> DataFrame:
    """One row about a round of eliminated(): step, total_rules, retained, eliminated, elimination_rate."""
    gone = F.count_if(~F.col("retained"))
    rate = gone / F.greatest(F.lit(1), F.count("*"))
    return judged.agg(F.lit(step).alias("step"), F.count("*").alias("total_rules"), F.count_if("retained").alias("retained"), gone.alias("eliminated"), rate.alias("elimination_rate"))


def history_summary(steps: DataFrame) -> DataFrame:
    """One row about all rounds: how many, the rules they dropped, and the last one's rate; no row without rounds."""
    out = steps.agg(F.count("*").alias("steps"), F.sum("eliminated").alias("total_eliminated"), F.max_by("elimination_rate", "step").alias("current_elimination_rate"))
    return out.where("steps > 0")


def statistics(rules: DataFrame) -> DataFrame:
    """One row: number of rules, least and largest confidence and priority."""
    return rules.agg(F.count("*").alias("rules"), *[f(c).alias(f"{n}_{c}") for c in ("cp", "priority") for n, f in (("min", F.min), ("max", F.max))])


def save(rules: DataFrame, path: str) -> None:
    """Rules as Parquet; load() reads them back."""
    rules.write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame | None:
    """Rules that save() has written; None if there are none."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    return spark.read.parquet(path)


def validity_period(paths: DataFrame) -> DataFrame:
    """(relation, validity) from paths (target relation, span of the path, gap between target and the path's end).

raw = mean span * type * (1 + 0.5 * min(1, n / 10)), type 1.5 for LONG_TERM, 0.5 for SHORT_TERM; at least 1.2 times
    the largest gap; then within half and three times the default.
    """
    table = F.create_map(*[x for k, v in VALIDITY.items() for x in (F.lit(k), F.lit(v))])
    default = F.coalesce(F.try_element_at(table, F.col("relation")), F.lit(DEFAULT_VALIDITY)).cast("double")
    kind = F.when(F.col("relation").isin(*LONG_TERM), 1.5).when(F.col("relation").isin(*SHORT_TERM), 0.5).otherwise(1.0)
    by = paths.groupBy("relation").agg(F.avg("span").alias("mean_span"), F.max("gap").alias("most_gap"), F.count("*").alias("n"))
    raw = F.col("mean_span") * kind * (1 + 0.5 * F.least(F.lit(1.0), F.col("n") / 10))
    return by.select("relation", F.least(F.greatest(F.greatest(1.2 * F.col("most_gap"), raw), 0.5 * default), 3 * default).alias("validity"))


def rules_of_paths(paths: DataFrame, validity: float = 30.0) -> DataFrame:
    """Rules from (path_id, target, path): head the target, body the relations of all facts but the last; of equal
    rules the first."""
    body = F.transform(F.slice("path", 1, F.size("path") - 1), lambda x: x["relation"])
    rules = paths.where(F.size("path") >= 2).select("path_id", F.col("target").alias("head"), body.alias("body"), F.col("path").alias("source_path"))
    first = rules.groupBy("head", "body").agg(F.min_by("source_path", "path_id").alias("source_path"), F.min("path_id").alias("rule_id"))
    return first.select("rule_id", "head", "body", F.lit(validity).alias("validity"), "source_path")


def path_in_validity(path: Column, target_day: Column, validity: Column) -> Column:
    """Whether all facts of a path lie at most `validity` days before the target, in time order."""
    near = F.forall(path, lambda x: target_day - x["day"] <= validity)
    ordered = F.size(F.filter(path, lambda x, i: (i > 0) & (F.get(path, i - 1)["day"] > x["day"]))) == 0
    return near & ordered


def longest_gap(gaps: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The validity of a rule as the largest gap between a path's end and the target (column `gap`), 30 without any."""
    return gaps.groupBy(*(by or [])).agg(F.coalesce(F.max("gap").cast("double"), F.lit(float(DEFAULT_VALIDITY))).alias("validity"))


def mean_pairwise_gap(facts: DataFrame) -> DataFrame:
    """(relation_a, relation_b, gap): mean of |day_a - day_b| over all pairs of facts of two relations, exactly.

    Facts are counted per relation and day. For each relation and day of the calendar the sum of distances to the
    relation's facts follows from running counts; so two relations meet by day, and the work is relations squared times
    days, not days squared.
    """
    by = facts.groupBy("relation", "day").agg(F.count("*").alias("n"))
    calendar = by.agg(F.collect_set("day").alias("days"))  # one row; as many days as the calendar has
    dense = by.select("relation").distinct().join(calendar).select("relation", F.explode("days").alias("day")).join(by, ["relation", "day"], "left")
    whole = Window.partitionBy("relation")
    upto = whole.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    n, days = F.coalesce("n", F.lit(0)).cast("double"), F.coalesce("n", F.lit(0)).cast("double") * F.col("day")
    dense = dense.select("relation", "day", F.sum(n).over(upto).alias("c"), F.sum(days).over(upto).alias("s"), F.sum(n).over(whole).alias("all_n"), F.sum(days).over(whole).alias("all_s"))
    distance = F.col("day") * F.col("c") - F.col("s") + (F.col("all_s") - F.col("s")) - F.col("day") * (F.col("all_n") - F.col("c"))
    a = dense.select(F.col("relation").alias("relation_a"), "day", distance.alias("distance"), "all_n")
    b = by.select(F.col("relation").alias("relation_b"), "day", "n")
    pairs = a.join(b, "day").where(F.col("relation_a") <= F.col("relation_b"))
    return pairs.groupBy("relation_a", "relation_b").agg((F.sum(F.col("distance") * F.col("n")) / (F.max("all_n") * F.sum("n"))).alias("gap"))


def composite_scores(facts: DataFrame, vectors: DataFrame) -> DataFrame:
    """(relation_a, relation_b, semantic, frequency, temporal, score): 0.5 * cosine of the relations' vectors + 0.3 *
    share of relation_b + 0.2 * min(1 / mean gap, 0.5) * 2; a gap that is missing or 0 gives 0.01."""
    from factline.functions.names import cosine

    gaps = mean_pairwise_gap(facts)
    total = facts.groupBy("relation").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    va, vb = (vectors.select(F.col("relation").alias(f"relation_{x}"), F.col("vector").alias(f"v_{x}")) for x in "ab")
    df = gaps.join(va, "relation_a", "left").join(vb, "relation_b", "left").join(total.select(F.col("relation").alias("relation_b"), "share"), "relation_b")
    temporal = F.when(F.col("gap") > 0, 1 / F.col("gap")).otherwise(0.01)
    df = df.select("relation_a", "relation_b", cosine(F.col("v_a"), F.col("v_b")).alias("semantic"), F.col("share").alias("frequency"), temporal.alias("temporal"))
    return df.withColumn("score", 0.5 * F.col("semantic") + 0.3 * F.col("frequency") + 0.2 * F.least("temporal", F.lit(0.5)) * 2)
