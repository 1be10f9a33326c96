"""The six decisions that a text model may take: which paths and chains make sense, how long a rule holds, how sure it is,
which rules outlive a change, and what a candidate is worth. Each makes one prompt per case, asks a provider, reads the
reply with column expressions, and leaves the formula's answer where there is no usable reply.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.functions import names
from factline.operators import replies

PER_PROMPT = 10  # cases of a list that one prompt shows; a longer list takes several prompts
RULES_PER_PROMPT = 100
LONGEST_VALIDITY = 3650.0


def numbers(reply: Column) -> Column:
    """All whole numbers of a reply, in order; null without a reply."""
    return F.transform(F.regexp_extract_all(reply, F.lit(r"\d+"), F.lit(0)), lambda x: x.try_cast("int"))


def labelled(reply: Column, label: str, number: Column) -> Column:
    """The value that a reply gives to <label><number>, as in {"C0": 0.85}; null without one."""
    pattern = rf'"?{label}(\d+)"?\s*[:=]\s*"?([0-9]+(?:\.[0-9]+)?|\.[0-9]+)'
    keys, values = (F.regexp_extract_all(reply, F.lit(pattern), F.lit(i)) for i in (1, 2))
    place = F.array_position(keys, number.cast("string"))
    return F.when(place > 0, F.get(values, (place - 1).cast("int")).try_cast("double"))


def listed(cases: DataFrame, by: str, order: list[str], line: Column, question: Column, most: int = PER_PROMPT) -> tuple[DataFrame, DataFrame]:
    """All cases of each `by` with their prompt `part` and their number `i` in it; and (query_id, by, part, prompt), a
    prompt for each `most` cases."""
    place = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    numbered = cases.withColumn("i", place).withColumn("part", F.floor(F.col("i") / most)).withColumn("i", F.col("i") % most)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("text")))), lambda x: x["text"]), "\n")
    prompts = numbered.groupBy(by, "part").agg(lines.alias("lines"))
    return numbered, prompts.select(F.xxhash64(by, "part").alias("query_id"), by, "part", F.concat(question, F.lit("\n"), "lines").alias("prompt"))


def chosen(cases: DataFrame, formula: DataFrame, by: str, order: list[str], line: Column, question: Column, provider: str | replies.Kept) -> DataFrame:
    """The cases whose numbers the replies list; of prompts without a number that is there, those of `formula` (some of
    the cases, told by `by` and `order`)."""
    numbered, prompts = listed(cases, by, order, line, question)
    said = prompts.drop("prompt").join(replies.ask(prompts, provider), "query_id").select(by, "part", numbers(F.col("reply")).alias("said"))
    kept = numbered.join(said, [by, "part"]).where(F.array_contains("said", F.col("i")))
    rest = numbered.join(formula.select(by, *order).distinct(), [by, *order], "left_semi").join(kept.select(by, "part").distinct(), [by, "part"], "left_anti")
    return kept.select(*cases.columns).unionByName(rest.select(*cases.columns))


def choose_paths(paths: DataFrame, formula: DataFrame, provider: str | replies.Kept) -> DataFrame:
    """Of paths (path_id, target, path) those that a model finds coherent; `formula`: those that the quality keeps."""
    question = F.concat(F.lit("Which of these paths lead to or support the relation "), "target", F.lit("? Answer with the numbers of the coherent paths.\n"))
    cases = paths.select("path_id", "target", "path")
    return chosen(cases, formula, "target", ["path_id"], names.path_text(F.col("i"), F.col("path")), question, provider)


def choose_chains(chains: DataFrame, provider: str | replies.Kept) -> DataFrame:
    """Of discovered chains (r1, r2, r3, n, mean_span) those that a model finds meaningful; all without a reply."""
    line = F.concat(F.col("i").cast("string"), F.lit(": "), F.concat_ws(" -> ", "r1", "r2", "r3"), F.lit(" ("), F.col("n").cast("string"), F.lit(" times)"))
    cases = chains.withColumn("list", F.lit("chains"))
    question = F.lit("Which of these chains of events are causes and effects? Answer with their numbers.\n")
    return chosen(cases, cases, "list", ["r1", "r2", "r3"], line, question, provider).drop("list")


def validities(spans: DataFrame, provider: str | replies.Kept) -> DataFrame:
    """(relation, judged): days for which a model says a relation's effect holds, from paths (relation, span, gap); only
    relations with a usable reply."""
    by = spans.groupBy("relation").agg(F.count("*").alias("n"), F.round(F.avg("span"), 1).alias("span"), F.max("gap").alias("gap"))
    text = lambda c: F.col(c).cast("string")
    prompt = F.concat(F.lit("For how many days does the relation "), "relation", F.lit(" keep its effect? "), text("n"), F.lit(" paths to it span "), text("span"), F.lit(" days on average and end at most "), text("gap"), F.lit(" days before it. Answer with a number of days."))
    prompts = by.select(F.xxhash64("relation").alias("query_id"), "relation", prompt.alias("prompt"))
    said = prompts.drop("prompt").join(replies.ask(prompts, provider), "query_id")
    days = F.regexp_extract("reply", r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return said.select("relation", days.alias("judged")).where("judged > 0").withColumn("judged", F.least("judged", F.lit(LONGEST_VALIDITY)))


def confidences(facts: DataFrame, rules: DataFrame, provider: str | replies.Kept) -> DataFrame:
    """(rule_id, judged): how sure a model is of rules (rule_id, head, body, validity), told the relations' counts."""
    by = facts.groupBy(F.col("relation").alias("name")).agg(F.count("*").alias("n"))
    parts = rules.select("rule_id", F.explode(F.concat(F.array("head"), "body")).alias("name")).join(by, "name", "left")
    counts = parts.groupBy("rule_id").agg(F.array_join(F.array_sort(F.collect_set(F.concat("name", F.lit(": "), F.coalesce("n", F.lit(0)).cast("string")))), ", ").alias("counts"))
    prompt = F.concat(F.lit("How sure is the rule "), names.rule_text(F.col("head"), F.col("body")), F.lit(" within "), F.col("validity").cast("string"), F.lit(" days? Facts per relation: "), "counts", F.lit(". Answer with a number from 0 to 1."))
    prompts = rules.join(counts, "rule_id").select(F.col("rule_id").alias("query_id"), prompt.alias("prompt"))
    return replies.ask(prompts, provider).select(F.col("query_id").alias("rule_id"), names.reply_score(F.col("reply")).alias("judged")).where("judged is not null")


def outliving(judged: DataFrame, span: float, provider: str | replies.Kept) -> DataFrame:
    """(rule_id, retained, judged_validity): which of eliminated()'s rules a model keeps, and for how many days; no row
    for the rules of a prompt without a usable reply. A reply names the rules to keep with their days, as {"R0": 30}."""
    line = F.concat(F.lit("R"), F.col("i").cast("string"), F.lit(": "), names.rule_text(F.col("head"), F.col("body")), *[x for c in ("cp", "priority", "validity") for x in (F.lit(f" {c}="), F.round(c, 3).cast("string"))])
    question = F.lit(f"New facts span {span:g} days. Which of these rules still hold, and for how many days each?\n")
    cases = judged.withColumn("list", F.lit("rules"))
    numbered, prompts = listed(cases, "list", ["rule_id"], line, question, RULES_PER_PROMPT)
    said = prompts.drop("prompt").join(replies.ask(prompts, provider), "query_id").select("list", "part", "reply")
    out = numbered.join(said, ["list", "part"]).select("part", "rule_id", labelled(F.col("reply"), "R", F.col("i")).alias("judged_validity"))
    some = out.groupBy("part").agg(F.count("judged_validity").alias("some"))
    return out.join(some, "part").where("some > 0").select("rule_id", F.col("judged_validity").isNotNull().alias("retained"), "judged_validity")


def adjusted(candidates: DataFrame, context: DataFrame, provider: str | replies.Kept, first: int = 20, per_prompt: int = 30) -> DataFrame:
    """(query_id, entity, score): what a model makes of the first candidates (query_id, entity, score) of each query, told
    `context` (query_id, context); only candidates that a reply scores."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entity")) - 1
    c = candidates.withColumn("place", place).where(F.col("place") < first)
    c = c.withColumn("batch", F.floor(F.col("place") / per_prompt)).withColumn("i", (F.col("place") % per_prompt).cast("int"))
    c = c.withColumn("prompt_id", F.xxhash64("query_id", "batch"))
    line = F.concat(F.lit("C"), F.col("i").cast("string"), F.lit(": "), "entity", F.lit(", score "), F.round("score", 4).cast("string"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", line.alias("text")))), lambda x: x["text"]), "\n")
    prompts = c.groupBy("prompt_id", "query_id").agg(lines.alias("lines")).join(context, "query_id", "left")
    text = F.concat(F.coalesce("context", F.lit("")), F.lit('\nAdjust the scores of these candidates; answer as {"C0": 0.85}.\n'), "lines")
    said = replies.ask(prompts.select(F.col("prompt_id").alias("query_id"), text.alias("prompt")), provider).select(F.col("query_id").alias("prompt_id"), "reply")
    scored = c.join(said, "prompt_id").select("query_id", "entity", labelled(F.col("reply"), "C", F.col("i")).alias("score"))
    return scored.where("score is not null").withColumn("score", F.least("score", F.lit(1.0)))


def graph_context(queries: DataFrame, window: DataFrame, rules: DataFrame, most_rules: int = 5, most_facts: int = 20) -> DataFrame:
    """(query_id, context): the best rules, the question, and the first facts of the subject's window (query_id, fact
    columns), for candidates of the graph side."""
    best = rules.orderBy(F.desc("priority"), "rule_id").limit(most_rules)
    told = best.agg(F.array_join(F.array_sort(F.collect_list(names.rule_text(F.col("head"), F.col("body")))), "\n").alias("rules"))  # one row
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("day", "row_id"))
    facts = window.withColumn("place", place).where(F.col("place") <= most_facts)
    said = facts.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", names.sentence("subject", "relation", "object", "ts").alias("text")))), lambda x: x["text"]), "\n").alias("facts"))
    out = queries.join(told).join(said, "query_id", "left")
    question = F.concat(F.lit("Question: ("), "subject", F.lit(", "), "relation", F.lit(", ?)"))
    return out.select("query_id", F.concat_ws("\n", F.lit("Rules:"), "rules", question, F.lit("Facts of the subject:"), F.coalesce("facts", F.lit("(none)"))).alias("context"))


def rule_context(queries: DataFrame, missing: DataFrame) -> DataFrame:
    """(query_id, context): the question and the relations of its rules that the subject's window lacks (query_id,
    relation, rank), for candidates of the rule side."""
    lacking = missing.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "relation"))), lambda x: x["relation"]), ", ").alias("lacking"))
    question = F.concat(F.lit("Question: ("), "subject", F.lit(", "), "relation", F.lit(", ?)\nNo fact of the subject with: "), F.coalesce("lacking", F.lit("(none missing)")))
    return queries.join(lacking, "query_id", "left").select("query_id", question.alias("context"))
