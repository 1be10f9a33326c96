"""Operators whose rows are bounded by facts, not by pairs of facts: against plain versions on random data, and by plan."""

import random

import pytest
from pyspark.sql import functions as F

from factline.operators import caserules, hotpairs, patterns, reasoning, rules

COLUMNS = "row_id long, subject string, relation string, object string, day long"


def made(n=400, subjects=3, objects=6, days=40, seed=1, start=19_700):
    rng = random.Random(seed)
    return [(i, f"s{rng.randrange(subjects)}", rng.choice(["a", "b", "c"]), f"{rng.choice('so')}{rng.randrange(objects)}", start + rng.randrange(days)) for i in range(n)]


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame(made(), COLUMNS).repartition(3)


def plain_rank(rows, s, o, t):
    counts = {}
    for _, fs, r, fo, d in rows:
        if fs == s and r == "c" and d > t:
            counts[fo] = counts.get(fo, 0) + 1
    own = counts.get(o, 0.5)
    return 1 + sum(c > own or (c == own and k < o) for k, c in counts.items()), o in counts


@pytest.mark.parametrize("in_one_task", [100_000, 0])
def test_case_rules_rank_as_a_plain_count(spark, facts, monkeypatch, in_one_task):
    monkeypatch.setattr(caserules, "IN_ONE_TASK", in_one_task)
    rows = made()
    found = caserules.body_instances(facts, "a", "b")
    got = {(r["subject"], r["object"], r["t2"]): (r["n"], r["rank"], r["supported"]) for r in caserules.ranked(found, facts, "c").collect()}
    want = {}
    for _, s1, r1, o1, t1 in rows:
        for _, s2, r2, o2, t2 in rows:
            if (s1, o1, r1, r2) == (s2, o2, "a", "b") and t1 < t2:
                n = want.get((s1, o1, t2), (0,))[0]
                want[s1, o1, t2] = (n + 1, *plain_rank(rows, s1, o1, t2))
    assert got == want and len({r for _, r, _ in got.values()}) > 3
    same = {(r["subject"], r["object"], r["t2"]): r["n"] for r in caserules.instances(caserules.body_matches(facts, "a", "a")).collect()}
    assert same == {(r["subject"], r["object"], r["t2"]): r["n"] for r in caserules.body_instances(facts, "a", "a").collect()}


def test_case_rules_without_heads(spark, facts):
    one = caserules.evaluate(facts, caserules.body_instances(facts, "a", "b"), "absent").collect()[0]
    assert one["cond_acc"] == 0 and one["mrr"] == 1.0
    assert caserules.evaluate(facts, caserules.body_instances(facts, "absent", "b"), "c").collect()[0]["matches"] == 0


@pytest.mark.parametrize("days, start", [(40, 19_700), (40, 17_985), (9_000, 10_000)])
def test_rule_scores_as_a_plain_sum(spark, days, start):
    """Also where days lie in several spans of the running sums."""
    import math

    rows = made(250, days=days, start=start)
    f = spark.createDataFrame(rows, COLUMNS)
    rules = [(1, ["a", "b"], 0.8, 0.9), (2, ["c"], 0.3, 0.6), (3, ["b", "a", "c"], 0.5, 0.7), (4, ["a"], 1.0, 0.1)]
    r = spark.createDataFrame(rules, "rule_id long, body array<string>, cp double, priority double")
    asked = [(i, f"s{i % 4}", start + random.Random(i).randrange(days)) for i in range(30)]
    q = spark.createDataFrame(asked, "query_id long, subject string, day long")
    want = {}
    for query, s, t in asked:
        for _, body, cp, priority in rules:
            if priority < 0.5:
                continue
            for _, fs, fr, fo, fd in rows:
                if fs != s or fr != body[0]:
                    continue
                at, path = fo, [fd]
                for step in body[1:]:
                    later = [(d, i, o) for i, s2, r2, o, d in rows if s2 == at and r2 == step and d > path[-1]]
                    if not later:
                        break
                    day, _, at = min(later)
                    path.append(day)
                if len(path) == len(body) and path[-1] <= t and at != s:
                    want[query, at] = want.get((query, at), 0) + sum(cp + math.exp(-0.1 * (t - d)) for d in path)
    got = {(x["query_id"], x["entity"]): x["score"] for x in reasoning.rule_scores(f, q, r).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, rel=1e-9) for k, v in want.items())


def test_first_facts_as_of_a_day(spark, facts):
    rows = made()
    asked = sorted({(s, o, d) for _, s, _, o, _ in rows[:40] for d in (19_699, 19_710, 19_720, 19_800)})
    q = spark.createDataFrame(asked, "subject string, object string, day long")
    for most in (1, 2, 3, 5):
        got = {(r["subject"], r["object"], r["day"]): list(r["firsts"]) for r in reasoning.first_as_of(facts, q, ["subject", "object"], F.col("row_id"), most).collect()}
        want = {(s, o, d): sorted(i for i, fs, _, fo, fd in rows if (fs, fo) == (s, o) and fd <= d)[:most] for s, o, d in asked}
        assert got == {k: v for k, v in want.items() if v}


def test_match_degrees_and_no_cross_join(spark):
    paths = spark.createDataFrame([(1, "x", ["b", "a", "a"]), (1, "y", ["z"]), (2, "x", ["c"]), (2, "y", []), (3, "x", ["a", "b"])], "query_id long, entity string, relations array<string>")
    rules = spark.createDataFrame([(["a", "b", "a"],), (["c", "d"],)], "body array<string>")
    c = paths.select("query_id", "entity", F.lit(1.0).alias("score"))
    out = reasoning.verify_graph(c, paths, rules)
    assert {(r["query_id"], r["entity"]): r["score"] for r in out.collect()} == {(1, "x"): 1.0, (1, "y"): 0.7, (2, "x"): 0.5, (2, "y"): 1.0, (3, "x"): 1.0}
    assert {r["score"] for r in reasoning.verify_graph(c, paths, rules.where("false")).collect()} == {1.0}
    plan = reasoning.match_degrees(paths, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner, (" in plan and "Join Cross" not in plan and "Join Inner\n" not in plan


@pytest.mark.parametrize("within", [0, 1, 7])
def test_bounded_patterns_make_no_far_pairs(spark, facts, within):
    chain = ("a", "b", "a")
    key = lambda df: sorted(map(tuple, df.select("row1", "row2", "row3").collect()))
    got = patterns.same_pair(facts, chain, within=within, distinct_events=True)
    want = patterns.same_pair(facts, chain, distinct_events=True).where(F.col("t3") - F.col("t1") <= within)
    assert key(got) == key(want) and (key(got) or within == 0)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert len(joins) == 2 and all("bucket" in j and f"<= {within})" in j for j in joins)


@pytest.mark.parametrize("block", [1, 3, 7, 100])
def test_confidences_in_blocks(spark, block):
    """One pair with many facts, in many blocks, and a few others: as in one window."""
    rng = random.Random(block)
    rows = [(i, "s" if i % 9 else "t", rng.choice("abcx"), "o", 100 + rng.randrange(60)) for i in range(120)] + [(200 + i, f"u{i % 4}", "a", "o", i) for i in range(9)]
    f = spark.createDataFrame(rows, COLUMNS)
    listed = [(1, ("a",), "x", 2.0), (2, ("a", "b"), "x", 4.0), (3, ("c", "a", "b"), "a", 9.0), (4, ("b", "b"), "never", 5.0), (5, ("a", "x"), "a", 0.0), (6, ("x", "a"), "never", 1.0)]
    want = sorted(map(tuple, rules.confidences(f, listed).select("rule_id", "b", "hb").collect()))
    got = sorted(map(tuple, hotpairs.confidences(f, listed, block).select("rule_id", "b", "hb").collect()))
    assert got == want and any(b > hb for _, b, hb in got)
    if block == 7:
        assert sorted(map(tuple, rules.confidences(f, listed, hot=50).select("rule_id", "b", "hb").collect())) == want
