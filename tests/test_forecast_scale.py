"""How often candidates move between facts and ranked answers; and the steps that saw to it, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F
from test_bounded import COLUMNS, made

from factline.operators import reasoning
from factline.plans import forecast


@pytest.fixture
def no_broadcast(spark):
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def exchanges(df):
    return [line for line in df._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange hashpartitioning(" in line]


def sides(spark):
    rng = random.Random(3)
    rows = lambda: [(q, f"e{e}", rng.random() * 3) for q in range(30) for e in rng.sample(range(60), 25)]
    return rows(), rows()


def test_fusion_moves_candidates_once(spark, no_broadcast):
    r, g = sides(spark)
    tables = [spark.createDataFrame(x, "query_id long, entity string, score double") for x in (r, g)]
    weights = spark.createDataFrame([(q, q / 30) for q in range(30)], "query_id long, alpha double")
    out = reasoning.fuse(*tables, weights)
    moved = exchanges(out)
    assert len(moved) == 2 and not any("entity" in x for x in moved)  # all candidates by query, and the weights
    scores = [{(q, e): x for q, e, x in side} for side in (r, g)]
    most = [{q: max(1.0, max(x for (p, _), x in s.items() if p == q)) for q in range(30)} for s in scores]
    want = {k: k[0] / 30 * scores[0].get(k, 0) / most[0][k[0]] + (1 - k[0] / 30) * scores[1].get(k, 0) / most[1][k[0]] for k in scores[0] | scores[1]}
    got = {(x["query_id"], x["entity"]): x for x in out.collect()}
    assert got.keys() == want.keys() and all(got[k]["score"] == pytest.approx(v) for k, v in want.items())
    for q in range(30):
        order = sorted((k for k in got if k[0] == q), key=lambda k: (-got[k]["score"], k[1]))
        assert [got[k]["rank"] for k in order] == list(range(1, len(order) + 1))


def test_first_of_a_side_are_verified_and_the_rest_pass(spark, no_broadcast):
    r, g = sides(spark)
    rule, graph = (spark.createDataFrame(x, "query_id long, entity string, score double") for x in (r, g))
    half, tenth, said = F.lit(0.5), F.lit(0.1), [(q, e, -1.0) for q, e, _ in r[::7]]
    direct = graph.where("entity < 'e3'").select("query_id", "entity")
    rows = reasoning.told(rule, reasoning.RULE, half).union(reasoning.told(graph, reasoning.GRAPH, half)).union(reasoning.told(direct, reasoning.DIRECT, tenth))
    rows = rows.union(reasoning.told(spark.createDataFrame(said, rule.schema), reasoning.RULE_SAID))
    got = {(x["query_id"], x["entity"]): (x["r"], x["g"]) for x in reasoning.fused(rows, True).collect()}
    model = rule.select("query_id", "entity", (F.col("score") * half).alias("formula")).join(spark.createDataFrame(said, rule.schema), ["query_id", "entity"], "left")
    r_want = reasoning.verify_first(rule, model.select("query_id", "entity", F.coalesce("score", "formula").alias("score")))
    g_want = reasoning.verify_first(graph, graph.withColumn("score", F.col("score") * F.when(F.col("entity") < "e3", 0.1).otherwise(0.5)))
    for i, df in enumerate((r_want, g_want)):
        want = {(x["query_id"], x["entity"]): x["score"] for x in df.collect()}
        most = {q: max([1.0, *(v for (p, _), v in want.items() if p == q)]) for q in range(30)}
        assert {k: x[i] for k, x in got.items() if x[i] is not None} == {k: v / most[k[0]] for k, v in want.items()}


@pytest.mark.parametrize("small", [100_000, 0])
def test_virtual_paths_as_a_plain_search(spark, monkeypatch, small):
    """Row ids that do not rise with time; with entities that are sent to all tasks, and not."""
    monkeypatch.setattr(reasoning, "SMALL", small)
    rows = made(300)
    f = spark.createDataFrame(rows, COLUMNS)
    asked = [(i, f"s{i % 4}", 19_698 + 2 * i) for i in range(25)]
    names = [f"{a}{i}" for a in "so" for i in range(7)]
    c = spark.createDataFrame([(q, n) for q, _, _ in asked for n in names], "query_id long, entity string")
    got = {(x["query_id"], x["entity"]): list(x["relations"]) for x in reasoning.virtual_paths(f, c, spark.createDataFrame(asked, "query_id long, subject string, day long")).collect()}
    want = {}
    for q, s, day in asked:
        past = sorted(x for x in rows if x[4] <= day)
        for n in names:
            first = lambda i, name: [x[2] for x in past if x[i] == name][:1]
            want[q, n] = [x[2] for x in past if (x[1], x[3]) == (s, n)][:3] or first(1, s) + first(3, n)
    assert got == want and len({len(x) for x in want.values()}) == 4


def test_answers_move_candidates_by_query_once(spark, no_broadcast):
    f = spark.createDataFrame(made(200), COLUMNS).withColumn("ts", F.to_date(F.lit("2024-01-01")))
    split = f.withColumn("split", F.when(F.col("day") > 19_735, "test").otherwise("train"))
    past = split.where("split = 'train'").select(*f.columns)
    queries = split.where("split = 'test'").select(F.col("row_id").alias("query_id"), "subject", "relation", "day")
    fact = "array<struct<subject:string,relation:string,object:string,day:long,row_id:long>>"
    ruled = spark.createDataFrame([(1, "a", ["b"], 30.0, [("s1", "b", "o2", 19_710, 3)], 0.8, 0.7, 0.8)], f"rule_id long, head string, body array<string>, validity double, source_path {fact}, cp double, coverage double, priority double")
    out = forecast.answer(past, queries, ruled)
    moved = exchanges(out)
    assert not any("query_id" in x and "entity" in x for x in moved)
    assert sum("hashpartitioning(query_id" in x for x in moved) <= 3  # candidates, questions, weights
    assert out.groupBy("query_id").count().where("count > 10").count() == 0 and out.select("query_id").distinct().count() == queries.count()
