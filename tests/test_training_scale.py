"""What training writes does not grow with the number of tasks."""

from pyspark.sql import functions as F
from test_fixtures import facts
from test_models import ROWS

from factline.operators import graphmodel


def test_a_round_writes_no_vectors_per_task(spark, monkeypatch):
    monkeypatch.setattr(graphmodel, "PER_TASK", 1)
    f = facts(spark, [(a, r, b, d + 7 * k) for k in range(20) for a, r, b, d in ROWS])
    real, written = graphmodel.durable, []

    def durable(df, name):
        out = real(df, name)
        if "vector" in out.columns or "g" in out.columns:
            written.append(out.where("kind not in ('weights', 'm', 'v', 'loss')").count() if "kind" in out.columns else out.count())
        return out

    monkeypatch.setattr(graphmodel, "durable", durable)
    model, _ = graphmodel.train(f, graphmodel.start(f), epochs=1, batch=4, negatives=3)
    assert model.steps == 1 and written and max(written) <= 6  # 4 entities and 2 relations, 35 tasks


def test_unknown_drawn_entities_take_no_part(spark):
    """A model that lacks an entity: its facts go, and so do the draws of it."""
    f = facts(spark, ROWS * 3)
    start = graphmodel.start(f.where("subject <> 'd' and object <> 'd'"))
    model, losses = graphmodel.train(f, start, epochs=1, batch=100, negatives=4)
    assert losses[0] > 0 and sorted(r["name"] for r in model.entities.collect()) == ["a", "b", "c"]


def test_copies_of_vectors_are_two_a_core(spark, monkeypatch):
    monkeypatch.setattr(graphmodel, "PER_TASK", 1)
    rows, _, total = graphmodel.keyed(facts(spark, [(a, r, b, d + 7 * k) for k in range(20) for a, r, b, d in ROWS]))
    dealt = graphmodel.dealt(rows, total, 4, 3, 42)
    assert dealt.select("task").distinct().count() > 20
    assert dealt.select("part").distinct().count() <= 2 * spark.sparkContext.defaultParallelism


def test_answers_carry_what_their_question_knows(spark):
    """Else candidates would be joined with their questions again, in a shuffle."""
    f = facts(spark, ROWS)
    q = spark.createDataFrame([(1, "a", "x", 9, "k"), (2, "b", "y", 8, None)], "query_id long, subject string, relation string, day long, out string")
    model = graphmodel.start(f)
    got = graphmodel.graph_scores(f, model, q, 3, ("subject", "day", "out"))
    plain = graphmodel.graph_scores(f, model, q, 3).join(q.drop("relation"), "query_id")
    rows = lambda df: sorted(map(str, df.select("query_id", "subject", "day", "out", "entity", F.round("score", 9)).collect()))
    assert rows(got) == rows(plain) and got.count() > 2
