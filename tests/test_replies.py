"""What a text model is asked: all cases, each prompt once; and what a run leaves for the next one."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from factline import __main__ as cli
from factline.operators import decisions, patterns, replies, rules
from factline.plans import forecast
from factline.sources import facts as sources

FACT = "array<struct<subject:string,relation:string,object:string,day:long,row_id:long,ts:date>>"


def counting(name, log, answer):
    """Registers a provider that notes each prompt in a file."""

    def make():
        def model(prompt):
            with open(log, "a") as f:
                f.write(repr(prompt) + "\n")
            return answer(prompt)

        return model

    replies.register(name)(make)
    return name


def made_facts(spark, n=300, seed=3):
    rng = random.Random(seed)
    rows = [(i, f"s{rng.randrange(8)}", rng.choice(["p", "q", "r"]), f"s{rng.randrange(8)}", 19_000 + i // 4) for i in range(n)]
    df = spark.createDataFrame([r for r in rows if r[1] != r[3]], "row_id long, subject string, relation string, object string, day long")
    return df.withColumn("ts", F.date_add(F.lit("1970-01-01").cast("date"), F.col("day").cast("int"))).cache()


def test_all_cases_of_a_long_list_are_asked(spark):
    path = [("a", "p", "b", 1, 1, None), ("b", "q", "c", 2, 2, None)]
    paths = spark.createDataFrame([(i, "p" if i < 34 else "q", path) for i in range(40)], f"path_id long, target string, path {FACT}")
    none = paths.where("false")
    assert sorted(r["path_id"] for r in decisions.choose_paths(paths, none, "agreeable").collect()) == list(range(40))
    # where one prompt of a list has no usable answer, the formula decides its cases alone
    replies.register("first_only")(lambda: lambda p: "0, 1" if "Path_0: (a" in p and "relation p?" in p else "nothing")
    formula = paths.where("path_id % 2 = 0")
    got = sorted(r["path_id"] for r in decisions.choose_paths(paths, formula, "first_only").collect())
    assert got == [0, 1, 10, 11, 20, 21, 30, 31, 34, 36, 38]
    chains = spark.createDataFrame([(f"r{i:02d}", "x", "y", i, 1.0) for i in range(25)], "r1 string, r2 string, r3 string, n long, mean_span double")
    assert decisions.choose_chains(chains, "agreeable").count() == 25
    judged = spark.createDataFrame([(i, "h", ["b"], 0.5, 0.5, 30.0) for i in range(250)], "rule_id long, head string, body array<string>, cp double, priority double, validity double")
    assert decisions.outliving(judged, 10.0, "agreeable").where("retained and judged_validity = 30").count() == 250


def test_equal_prompts_are_asked_once(spark, tmp_path):
    log = tmp_path / "log"
    name = counting("noting", str(log), lambda p: None if "odd" in p else f"said {p}")
    kept = replies.Kept(name, f"file://{tmp_path}/replies")
    prompts = spark.createDataFrame([(i, f"prompt {i % 5}") for i in range(40)] + [(99, "odd")], "query_id long, prompt string").repartition(5)
    got = replies.ask(prompts, kept, tries=1, votes=2)
    for _ in range(2):  # reading the result again asks nothing
        assert {(r["query_id"], r["vote"]): r["reply"] for r in got.collect()} == {(i, v): f"said prompt {i % 5}" for i in range(40) for v in (0, 1)} | {(99, 0): None, (99, 1): None}
    assert Counter(log.read_text().split("\n")[:-1]) == {repr(f"prompt {i}"): 2 for i in range(5)} | {repr("odd"): 2}
    log.write_text("")
    assert replies.ask(prompts.where("query_id < 40"), kept, votes=2).count() == 80 and log.read_text() == ""  # a later run
    assert replies.ask(prompts, replies.Kept("silent", kept.path)).where("reply is not null").count() == 0  # another's replies


def test_a_plan_asks_each_prompt_once_and_a_resumed_one_none(spark, tmp_path):
    log = tmp_path / "log"
    agreeable = replies._agreeable()
    name = counting("noting_plan", str(log), lambda p: agreeable(p) or "0.6")
    s = forecast.Settings(provider=name, replies=f"file://{tmp_path}/replies", rules_path=f"file://{tmp_path}/rules", top_relations=2, heads=2)
    f = made_facts(spark)
    ruled, ranked, metrics = forecast.forecast(f, s=s)
    rows = lambda df: sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.collect())
    first = (rows(ruled), rows(ranked), rows(metrics))
    counts = Counter(log.read_text().split("\n")[:-1])
    assert counts and set(counts.values()) == {1}
    log.write_text("")
    ruled, ranked, metrics = forecast.forecast(f, s=s)
    assert (rows(ruled), rows(ranked), rows(metrics)) == first
    assert log.read_text() == ""
    assert rules.load(spark, s.rules_path).count() == ruled.count() > 0


def test_stability_over_drawn_questions(spark):
    f = made_facts(spark)
    got = {r["settings"]: r for r in forecast.stability(f, {"all": forecast.Settings(top_relations=2), "unverified": forecast.Settings(top_relations=2, verify=False)}, questions=10, repeats=2).collect()}
    assert {(r["repeats"], r["queries"]) for r in got.values()} == {(2, 20)}
    assert all(0 <= r["mrr"] <= 1 and r["mrr_spread"] >= 0 for r in got.values())


def test_questions_without_candidates_get_every_entity_but_their_subject(spark):
    f = spark.createDataFrame([(i, f"a{i}", "p", "hub", 10) for i in range(3)], "row_id long, subject string, relation string, object string, day long")
    f = f.withColumn("ts", F.lit("1970-01-11").cast("date"))
    q = spark.createDataFrame([(1, "nobody", "q", 5), (2, "hub", "q", 5)], "query_id long, subject string, relation string, day long")
    none = rules.rules_of_paths(spark.createDataFrame([], f"path_id long, target string, path {FACT}")).withColumns({c: F.lit(0.0) for c in ("cp", "coverage", "priority")})
    got = forecast.answer(f, q, none).where("query_id = 1").orderBy("rank").collect()
    assert [r["entity"] for r in got] == ["hub", "a0", "a1", "a2"]


def test_command_line(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    lines = [f"s{rng.randrange(5)},{rng.choice(['Accuse', 'Criticize_or_denounce', 'Protest_or_demonstrate'])},t{rng.randrange(3)},2014-0{1 + i // 28}-{1 + i % 28:02d}" for i in range(200)]
    (tmp_path / "facts.csv").write_text("subject,relation,object,timestamp\n" + "\n".join(lines) + "\n")
    monkeypatch.setattr(cli, "build_session", lambda *a: spark)
    out = f"file://{tmp_path}/out"
    for _ in range(2):  # the second run reads the rules of the first
        cli.main([f"file://{tmp_path}/facts", out, "--rules", f"{out}/kept", "--patterns", "--no-verify"])
    assert spark.read.json(f"{out}/metrics").collect()[0]["queries"] == 20
    matches = spark.read.parquet(f"{out}/matches")
    want = patterns.match_all(sources.load(spark, f"file://{tmp_path}/facts"))
    assert matches.count() == want.count() > 0
    assert {r["pattern"] for r in matches.select("pattern").distinct().collect()} == {"conflict_escalation"}


def test_lists_of_entities(spark, tmp_path):
    (tmp_path / "list.txt").write_text("a\n\n b \na\n")
    assert sorted(r[0] for r in sources.read_list(spark, f"file://{tmp_path}/list.txt").collect()) in (["a", "a", "b"], ["a", "b"])


@pytest.fixture(autouse=True)
def _known():
    before = dict(replies._providers)
    yield
    replies._providers.clear()
    replies._providers.update(before)
