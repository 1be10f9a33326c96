"""Counts advanced step by step against rules judged on all facts so far."""

import random

import pytest
from pyspark.sql import functions as F

from factline.operators import incremental, rules

RULES = ((1, ("a",), "x", 3.0), (2, ("a", "b"), "x", 6.0), (3, ("c", "a", "b"), "a", 9.0), (4, ("never",), "a", 5.0))
ROUND = [c for c in ("cp", "coverage", "priority", "validity")]


def made(spark, n=240):
    rng = random.Random(8)
    rows = [(i, f"s{rng.randrange(3)}", rng.choice("abcx"), f"o{rng.randrange(2)}", 100 + i // 5) for i in range(n)]
    return spark.createDataFrame(rows, incremental.FACTS)


def rows(df):
    return sorted(str([round(x, 9) if isinstance(x, float) else x for x in r]) for r in df.select(sorted(df.columns)).collect())


def test_each_step_equals_a_full_evaluation(spark, tmp_path):
    facts = made(spark)
    state = incremental.State(spark, f"file://{tmp_path}", RULES)
    for low, high in ((0, 2), (2, 90), (90, 90), (90, 240)):  # fewer facts than the longest body, many, none
        state = incremental.advance(state, facts.where((F.col("row_id") >= low) & (F.col("row_id") < high)))
        so_far = facts.where(F.col("row_id") < high)
        assert rows(incremental.evaluate(state)) == rows(rules.evaluate(so_far, list(RULES)))
    assert rows(incremental.evolve(state)) == rows(rules.evolve(facts, facts, list(RULES)))
    state = incremental.opened(spark, incremental.saved(state))
    assert state.step == 4 and state.facts().count() == 240
    with pytest.raises(ValueError, match="come after"):
        incremental.advance(state, facts.where("row_id < 5"))


def test_a_stream_advances_the_state(spark, tmp_path):
    facts = made(spark, 90)
    seen = []
    stream = None
    for k in range(2):
        facts.where(f"floor(row_id / 45) = {k}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(facts.schema).parquet(str(tmp_path / "in"))
        incremental.evolve_stream(stream, f"file://{tmp_path}/state", RULES[:2], str(tmp_path / "checkpoint"), seen.append).awaitTermination()
    assert [s.step for s in seen] == [1, 2]
    assert rows(incremental.evaluate(seen[-1])) == rows(rules.evaluate(facts, list(RULES[:2])))
