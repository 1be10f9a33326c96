"""Best entities by cosine in cells of a grid, against all products, and by plan."""

import numpy as np
import pytest

from factline.operators import embed


@pytest.mark.parametrize("rows, columns", [(512, 2_048), (7, 30), (3, 1)])
def test_best_pairs_against_all_products(monkeypatch, rows, columns):
    monkeypatch.setattr(embed, "ROWS", rows)
    monkeypatch.setattr(embed, "COLUMNS", columns)
    rng = np.random.default_rng(5)
    e = rng.normal(size=(300, 4))
    e[100:140] = e[40]  # ties, by place
    e[200:220] = 0
    e, q = e / np.maximum(np.linalg.norm(e, axis=1, keepdims=True), 1e-9), rng.normal(size=(25, 4))
    q[3], q[4], own = e[40], 0, np.where(np.arange(25) % 3, np.arange(25) * 5, -1)
    want = {}
    for i in range(25):
        s = sorted((-float((q[i] * e[j]).sum()), j) for j in range(300) if j != own[i])
        want[i] = [(j, -x) for x, j in s if x < 0][:20]
    got = {i: [] for i in range(25)}
    for i, j, x in zip(*embed.best_pairs(q, e, own, 20)):
        got[i].append((j, x))
    assert all([j for j, _ in got[i]] == [j for j, _ in want[i]] for i in want) and not got[4]
    assert all(x == pytest.approx(y) for i in want for (_, x), (_, y) in zip(got[i], want[i]))


@pytest.mark.parametrize("entities", [1_000, 9])
def test_top_by_cosine_in_one_cell_a_question_and_in_more(spark, monkeypatch, entities):
    monkeypatch.setattr(embed, "ENTITIES", entities)
    monkeypatch.setattr(embed, "BLOCK", 5)
    monkeypatch.setattr(embed, "QUESTIONS", 5)
    rng = np.random.default_rng(6)
    e, q = rng.normal(size=(40, 3)), rng.normal(size=(23, 3))
    table = spark.createDataFrame([(f"n{i:02d}", x.tolist()) for i, x in enumerate(e)], "name string, vector array<double>")
    asked = spark.createDataFrame([(i, f"n{i:02d}", x.tolist()) for i, x in enumerate(q)], "asked_id long, subject string, q array<double>")
    df = embed.top_by_cosine(asked, table, 6)
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["asked_id"], -r["score"], r["entity"])):
        got.setdefault(r["asked_id"], []).append(r["entity"])
    for i in range(23):
        s = sorted((-q[i] @ e[j] / np.linalg.norm(q[i]) / np.linalg.norm(e[j]), f"n{j:02d}") for j in range(40) if j != i)
        assert got[i] == [n for x, n in s if x < 0][:6]
    assert ("Window" in df._jdf.queryExecution().optimizedPlan().toString()) == (entities < 40)
