"""Work of training and of graph answers: against plain versions, and that it is not done twice."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_fixtures import facts
from test_models import ROWS

from factline.functions import names
from factline.operators import embed, graphmodel


def test_alike_questions_meet_near_entities_only(monkeypatch):
    rng = np.random.default_rng(8)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    e, middles = unit(rng.normal(size=(6_000, 16))), unit(rng.normal(size=(3, 16)))
    q = unit(middles[rng.integers(0, 3, 400)] + 0.01 * rng.normal(size=(400, 16)))
    q[7], own = -q[7], np.where(np.arange(400) % 2, rng.integers(0, 6_000, 400), -1)
    monkeypatch.setattr(embed, "ROWS", 50)
    monkeypatch.setattr(embed, "COLUMNS", 200)
    real, products = np.matmul, []
    monkeypatch.setattr(embed.np, "matmul", lambda a, b, out: products.append(out.size) or real(a, b, out=out))
    got = {i: [] for i in range(400)}
    for i, j, x in zip(*embed.best_pairs(q, e, own, 20)):
        got[i].append((j, x))
    assert 0 < sum(products) < 0.5 * len(q) * len(e)
    scores = q @ e.T
    for i in range(400):
        want = [j for j in np.argsort(-scores[i], kind="stable") if j != own[i] and scores[i, j] > 0][:20]
        assert [j for j, _ in got[i]] == want and [x for _, x in got[i]] == pytest.approx(scores[i, want])


def test_vectors_move_as_under_adam_when_looked_at():
    rng = np.random.default_rng(9)
    start = rng.normal(size=(1_300, 4))
    start[5] = 0
    plain, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    lazy = graphmodel.Vectors(start.copy(), 0.02, 1e-3)
    for step in range(1, 8):
        rows = rng.choice(1_200, 700 if step == 4 else 30, replace=False)
        slopes = rng.normal(size=(len(rows), 4)) * (step != 6)
        assert np.allclose(lazy.at(rows, step - 1), plain[rows], rtol=0, atol=1e-13)
        lazy.step(slopes)
        g = 1e-3 * plain
        g[rows] += slopes
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        plain = plain - 0.02 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    assert (lazy.done[1_200:] == 0).all()  # not moved so far
    assert np.allclose(lazy.at(np.arange(1_300), 7), plain, rtol=0, atol=1e-13)
    assert np.allclose(graphmodel.rested(start, 7, 0.02, 1e-3)[1_200:], plain[1_200:], rtol=0, atol=1e-13)


def test_each_part_has_a_partition_of_its_own(spark, monkeypatch):
    monkeypatch.setattr(graphmodel, "PER_TASK", 1)
    rows, _, total = graphmodel.keyed(facts(spark, [(a, r, b, d + 7 * k) for k in range(20) for a, r, b, d in ROWS]))
    dealt = graphmodel.dealt(rows, total, 4, 3, 42)
    where = {(r[0], r[1]) for r in dealt.select("part", F.spark_partition_id()).distinct().collect()}
    assert len(where) == len({p for p, _ in where}) == len({i for _, i in where}) > 4


@pytest.mark.parametrize("cells", [1, 3])
def test_each_cell_has_a_partition_of_its_own(spark, monkeypatch, cells):
    monkeypatch.setattr(embed, "BLOCK", 2)
    monkeypatch.setattr(embed, "ENTITIES", -(-30 // cells))
    rng = np.random.default_rng(10)
    table = spark.createDataFrame([(f"n{i:02d}", x.tolist()) for i, x in enumerate(rng.normal(size=(30, 3)))], "name string, vector array<double>")
    asked = spark.createDataFrame([(i, f"n{i:02d}", x.tolist()) for i, x in enumerate(rng.normal(size=(16, 3)))], "asked_id long, subject string, q array<double>")
    plan = embed.top_by_cosine(asked, table, 4)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("shufflepartitionidpassthrough") == 2 and "hashpartitioning(cell" not in plan


def test_vectors_that_are_sent_to_all_parts_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(graphmodel, "PER_TASK", 1)
    f = facts(spark, [(a, r, b, d + 7 * k) for k in range(6) for a, r, b, d in ROWS])
    model = graphmodel.start(f)
    rows, names_, total = graphmodel.keyed(f)
    tables = [t.join(names_.where(F.col("kind") == k), "name").select("id", "vector") for k, t in (("entity", model.entities), ("relation", model.relations))]
    parts = graphmodel.layout(rows, 4)[3]
    got = []
    for everywhere in (True, False):
        df = graphmodel.changes(graphmodel.dealt(rows, total, 4, 3, 42), tables[0].union(tables[1]), model, parts, everywhere, 0.01, 0.5, 1e-5, 1.0, 0.0, 42)
        got.append(sorted((r["kind"], r["id"], r["n"], tuple(r["g"])) for r in df.collect()))
    assert got[0] == got[1] and len({x[0] for x in got[0]}) == 5


def test_names_of_one_word_and_of_more(spark):
    def plain(a, b):
        if a == b:
            return 1.0
        k = next((i for i in (5, 4, 3, 2) if min(len(a), len(b)) >= i and a[:i] == b[:i]), 0)
        n = len(set(a.split()) & set(b.split()))
        return min(1.0, max(0.1, ((0.5 + 0.1 * k if k >= 4 else 0.3 + 0.1 * k if k else 0.2) + (0.3 + 0.2 * min(n, 3) if n else 0.2)) / 2))

    words = ["u1", "u12", "u123456", "", "x", "x y", "y\tx z w", "u1 ", "abcd ef", "abcde", "ef"]
    rows = spark.createDataFrame([(a, b) for a in words for b in words], "a string, b string")
    assert all(r["s"] == plain(r["a"], r["b"]) for r in rows.select("a", "b", names.name_similarity(F.col("a"), F.col("b")).alias("s")).collect())
