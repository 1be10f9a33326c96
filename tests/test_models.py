"""The trained graph side and the decisions of text models, against plain versions."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_fixtures import facts

from factline.functions import names
from factline.operators import decisions, embed, graphmodel, reasoning, replies, rules
from factline.plans import forecast

ROWS = [("a", "x", "b", 1), ("b", "x", "c", 2), ("c", "y", "a", 3), ("a", "y", "d", 4), ("d", "x", "b", 5), ("b", "y", "a", 400), ("c", "x", "b", 401)]


def test_gradients_are_the_slopes_of_the_loss():
    rng = np.random.default_rng(1)
    d = 5
    w = graphmodel.first_weights(d, 2, 3)
    h, e = rng.normal(size=(6, d)), rng.normal(size=(2, d))
    rows = np.array([[0, 0, 1], [1, 1, 2], [2, 0, 1], [0, 1, 3], [3, 0, 4], [4, 1, 0]])
    time, others = rng.uniform(0, 2, 6), rng.integers(0, 6, (6, 3))
    loss = lambda w, h, e: graphmodel.batch_gradient(w, 2, h, e, rows, time, others, 0.5)[0]
    base, g, d_h, d_e = graphmodel.batch_gradient(w, 2, h, e, rows, time, others, 0.5)
    assert base > 0 and set(g) == set(w)
    step = 1e-6
    for k in w:
        for at in [tuple(rng.integers(0, n) for n in w[k].shape) for _ in range(3)]:
            more = {**w, k: w[k].copy()}
            more[k][at] += step
            assert abs((loss(more, h, e) - base) / step - g[k][at]) < 1e-4
    for table, slope, put in ((h, d_h, lambda x: (w, x, e)), (e, d_e, lambda x: (w, h, x))):
        for i in range(len(table)):
            more = table.copy()
            more[i, i % d] += step
            assert abs((loss(*put(more)) - base) / step - slope[i, i % d]) < 1e-4


def plain_scores(rows, w, entities, relations, origin, subject, relation, day):
    """Scores of all entities for one question, fact by fact and entity by entity."""
    now = dict(entities)
    for k in range(2):
        new = dict(now)
        for name, own in now.items():
            into = [(now[s], relations[r], (t - origin) / 365) for s, r, o, t in rows if o == name]
            if not into:
                continue
            messages = [w[f"{k}.head"] @ s + w[f"{k}.relation"] @ r + w[f"{k}.tail"] @ own + w[f"{k}.bias"] + t * w[f"{k}.time"] for s, r, t in into]
            z = own + w[f"{k}.own"] @ own + w[f"{k}.got"] @ np.mean(messages, axis=0) + w[f"{k}.add"]
            new[name] = (z - z.mean()) / np.sqrt(z.var() + 1e-5) * w[f"{k}.gain"] + w[f"{k}.shift"]
        now = new
    x = np.concatenate([now[subject], relations[relation], (day - origin) / 365 * w["q.time"] + w["q.time_bias"]])
    q = w["q.out"] @ np.maximum(0, w["q.in"] @ x + w["q.in_bias"]) + w["q.out_bias"]
    return {n: float(q @ v / np.linalg.norm(q) / np.linalg.norm(v)) for n, v in now.items() if n != subject}


def test_graph_scores_against_a_plain_version(spark, tmp_path, monkeypatch):
    f = facts(spark, ROWS)
    model = graphmodel.start(f)
    table = lambda df: {r["name"]: np.array(r["vector"]) for r in df.collect()}
    q = spark.createDataFrame([(1, "a", "x", 402), (2, "d", "y", 500), (3, "new", "x", 402)], "query_id long, subject string, relation string, day long")
    want = {i: plain_scores(ROWS, model.weights, table(model.entities), table(model.relations), 1, s, r, d) for i, s, r, d in ((1, "a", "x", 402), (2, "d", "y", 500))}
    for block in (4096, 1):
        monkeypatch.setattr(embed, "BLOCK", block)
        got = {}
        for r in graphmodel.graph_scores(f, model, q, top=2).collect():
            got.setdefault(r["query_id"], {})[r["entity"]] = r["score"]
        for i, scores in want.items():
            best = sorted((x for x in scores.items() if x[1] > 0), key=lambda x: (-x[1], x[0]))[:2]
            assert got.get(i, {}) == pytest.approx(dict(best))
        assert 3 not in got
    graphmodel.save(model, str(tmp_path / "model"))
    again = graphmodel.load(spark, str(tmp_path / "model"))
    assert {(r["query_id"], r["entity"]): r["score"] for r in graphmodel.graph_scores(f, again, q, top=2).collect()} == pytest.approx({(i, n): x for i, s in got.items() for n, x in s.items()})
    assert graphmodel.load(spark, str(tmp_path / "none")) is None


def test_training_lowers_the_loss(spark):
    f = facts(spark, ROWS * 3)
    model, losses = graphmodel.train(f, graphmodel.start(f), epochs=4, rate=0.05, batch=100, negatives=4)
    assert model.steps == 4 and losses[-1] < losses[0]
    assert model.entities.count() == 4 and model.relations.count() == 2


def test_dropped_values_have_no_slope():
    rng = np.random.default_rng(2)
    d = 4
    w = graphmodel.first_weights(d, 1, 3)
    h, e = rng.normal(size=(5, d)), rng.normal(size=(2, d))
    rows, time, others = np.array([[0, 0, 1], [1, 1, 2], [2, 0, 3], [3, 1, 4]]), rng.uniform(0, 2, 4), rng.integers(0, 5, (4, 3))
    mask = np.ones((2, 2 * d))
    mask[:, 3] = 0
    base, g, _, _ = graphmodel.batch_gradient(w, 1, h, e, rows, time, others, 0.5, mask)
    assert (g["q.in"][3] == 0).all() and (g["q.out"][:, 3] == 0).all() and base > 0
    more = {**w, "q.in": w["q.in"].copy()}
    more["q.in"][1, 2] += 1e-6
    assert abs((graphmodel.batch_gradient(more, 1, h, e, rows, time, others, 0.5, mask)[0] - base) / 1e-6 - g["q.in"][1, 2]) < 1e-4


def test_a_round_against_a_plain_version(spark, monkeypatch, tmp_path):
    """Each task steps on its batches from the same start; changes are averaged; moments go on after saving and loading."""
    monkeypatch.setattr(graphmodel, "PER_TASK", 2)
    f = facts(spark, [(a, r, b, d + 7 * k) for k in range(6) for a, r, b, d in ROWS])
    model = graphmodel.start(f)
    table = lambda df: {r["name"]: np.array(r["vector"]) for r in df.collect()}
    for round_ in range(2):
        rows = graphmodel._batches(f, model, 8, 3, 42 + round_).collect()
        assert len({r["task"] for r in rows}) > 1 and len({r["batch"] for r in rows}) > 3
        entities, relations = table(model.entities), table(model.relations)
        deltas = {}
        for task in {r["task"] for r in rows}:
            mine = [r for r in rows if r["task"] == task]
            names = sorted({n for r in mine for n in (r["subject"], r["object"], *(x["name"] for x in r["others"]))})
            kinds = sorted({r["relation"] for r in mine})
            values = {k: x.copy() for k, x in model.weights.items()} | {"h": np.array([entities[n] for n in names]), "e": np.array([relations[n] for n in kinds])}
            start = {k: x.copy() for k, x in values.items()}
            m = {k: model.moments[k][0].copy() if k in model.moments else np.zeros_like(x) for k, x in values.items()}
            v = {k: model.moments[k][1].copy() if k in model.moments else np.zeros_like(x) for k, x in values.items()}
            before = model.steps * 2 if model.moments else 0
            for t, b in enumerate(sorted({r["batch"] for r in mine}), 1):
                at = sorted((r for r in mine if r["batch"] == b), key=lambda r: (r["day"], r["row_id"]))
                index = np.array([(names.index(r["subject"]), kinds.index(r["relation"]), names.index(r["object"])) for r in at])
                others = np.array([[names.index(x["name"]) for x in r["others"]] for r in at])
                time = np.array([(r["day"] - model.origin) / 365 for r in at])
                _, g, g["h"], g["e"] = graphmodel.batch_gradient({k: values[k] for k in model.weights}, 2, values["h"], values["e"], index, time, others, 0.5)
                norm = np.sqrt(sum((x * x).sum() for x in g.values()))
                for k in values:
                    n = t + (before if k in model.weights else 0)
                    slope = g[k] * min(1, 1 / (norm + 1e-6)) + 1e-5 * values[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * slope, 0.999 * v[k] + 0.001 * slope**2
                    values[k] = values[k] - 0.02 * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)
            for k in model.weights:
                deltas.setdefault(k, []).append(values[k] - start[k])
            for i, n in enumerate(names):
                deltas.setdefault(("entity", n), []).append(values["h"][i] - start["h"][i])
        new, _ = graphmodel.train(f, model, epochs=1, rate=0.02, batch=8, negatives=3, dropout=0.0)
        for k, x in model.weights.items():
            assert np.allclose(new.weights[k], x + np.mean(deltas[k], axis=0), atol=1e-9), (round_, k)
        for n, x in table(new.entities).items():
            assert np.allclose(x, entities[n] + np.mean(deltas.get(("entity", n), [0 * x]), axis=0), atol=1e-9)
        graphmodel.save(new, str(tmp_path / f"round{round_}"))
        model = graphmodel.load(spark, str(tmp_path / f"round{round_}"))
        assert model.moments and model.steps == round_ + 1


def test_training_learns(spark):
    """Objects follow from subject and relation: the trained model ranks them higher than the untrained one and than
    messages without weights."""
    import random

    rng = random.Random(11)
    to = {r: rng.sample(range(20), 20) for r in "xy"}
    rows = []
    for day in range(1500):
        s, r = rng.randrange(20), rng.choice("xy")
        rows.append((f"n{s}", r, f"n{to[r][s]}", day))
    past, asked = facts(spark, rows), [(i, f"n{s}", r, 1500) for i, (s, r) in enumerate((s, r) for s in range(20) for r in "xy" if to[r][s] != s)]
    q = spark.createDataFrame(asked, "query_id long, subject string, relation string, day long")
    truth = {i: f"n{to[r][int(s[1:])]}" for i, s, r, _ in asked}

    def mrr(scores):
        lists = {}
        for x in scores.collect():
            lists.setdefault(x["query_id"], []).append((-x["score"], x["entity"]))
        places = {i: [e for _, e in sorted(v)] for i, v in lists.items()}
        return np.mean([1 / (places[i].index(o) + 1) if o in places.get(i, []) else 0 for i, o in truth.items()])

    start = graphmodel.start(past)
    trained, losses = graphmodel.train(past, start, epochs=12, rate=0.02, batch=64, negatives=8)
    plain = embed.graph_scores(embed.message_layer(past, embed.entity_vectors(past)), q)
    got = [mrr(x) for x in (graphmodel.graph_scores(past, trained, q), graphmodel.graph_scores(past, start, q), plain)]
    assert losses[-1] < 0.6 * losses[0] and got[0] > 1.2 * max(got[1:]), (losses, got)


def scripted(name, reply):
    """A provider that answers from a function of the prompt."""
    replies.register(name)(lambda: reply)
    return name


def test_paths_are_chosen_by_reply_or_formula(spark):
    path = "array<struct<subject:string,relation:string,object:string,day:long,row_id:long>>"
    rows = [(i, t, [("a", "x", "b", 1, 0), ("b", "y", "c", 2, 1)]) for i, t in ((1, "p"), (2, "p"), (3, "p"), (4, "q"), (5, "q"))]
    paths = spark.createDataFrame(rows, f"path_id long, target string, path {path}")
    formula = paths.where("path_id in (3, 5)")
    provider = scripted("some", lambda p: '{"valid": [0, 2, 7]}' if "relation p" in p else "none of them")
    assert sorted(r["path_id"] for r in decisions.choose_paths(paths, formula, provider).collect()) == [1, 3, 5]
    assert sorted(r["path_id"] for r in decisions.choose_paths(paths, formula, "silent").collect()) == [3, 5]


def test_chains_periods_and_confidences_by_reply(spark):
    chains = spark.createDataFrame([("a", "b", "c", 5, 1.0), ("b", "c", "d", 4, 2.0)], "r1 string, r2 string, r3 string, n long, mean_span double")
    assert [r["r1"] for r in decisions.choose_chains(chains, scripted("second", lambda p: "only 1")).collect()] == ["b"]
    assert decisions.choose_chains(chains, "silent").count() == 2
    spans = spark.createDataFrame([("x", 3, 1), ("x", 5, 2), ("y", 1, 1)], "relation string, span long, gap long")
    said = scripted("days", lambda p: "about 45 days" if "relation x" in p else "no idea")
    assert [tuple(r) for r in decisions.validities(spans, said).collect()] == [("x", 45.0)]
    f = facts(spark, ROWS)
    listed = [(1, ("x",), "y", 9.0), (2, ("nothing",), "y", 9.0)]
    table = spark.createDataFrame([(i, h, list(b), v) for i, b, h, v in listed], "rule_id long, head string, body array<string>, validity double")
    sure = scripted("sure", lambda p: "0.9" if "nothing" in p else None)
    got = {r["rule_id"]: r for r in rules.evaluate(f, listed, decisions.confidences(f, table, sure)).collect()}
    plain = {r["rule_id"]: r for r in rules.evaluate(f, listed).collect()}
    assert got[2]["b"] == 0 and got[2]["cp"] == 0.9 != plain[2]["cp"] and got[1]["cp"] == plain[1]["cp"]


def test_rules_and_candidates_by_reply(spark):
    judged = spark.createDataFrame([(7, "h", ["x"], 0.5, 0.5, 30.0, True), (9, "h", ["y"], 0.7, 0.7, 20.0, True)], "rule_id long, head string, body array<string>, cp double, priority double, validity double, retained boolean")
    said = {r["rule_id"]: (r["retained"], r["judged_validity"]) for r in decisions.outliving(judged, 90.0, scripted("one", lambda p: '{"R1": 60}')).collect()}
    assert said == {7: (False, None), 9: (True, 60.0)}
    assert decisions.outliving(judged, 90.0, "silent").count() == 0
    c = spark.createDataFrame([(1, f"e{i:02d}", 1.0 - i / 100) for i in range(40)], "query_id long, entity string, score double")
    context = spark.createDataFrame([(1, "told")], "query_id long, context string")

    def half(prompt):
        assert prompt.startswith("told") and len(re.findall(r"(?m)^C\d+: ", prompt)) <= 8
        return '{"C0": 0.5, "C1": 7}'

    got = {r["entity"]: r["score"] for r in decisions.adjusted(c, context, scripted("half", half), first=20, per_prompt=8).collect()}
    assert got == {"e00": 0.5, "e01": 1.0, "e08": 0.5, "e09": 1.0, "e16": 0.5, "e17": 1.0}


def test_other_words_and_failures(spark):
    replies.varied("echo_number", "other_words", "Think first.")
    prompts = spark.createDataFrame([(1, "rate 0.7")], "query_id long, prompt string")
    assert replies.ask(prompts, "other_words").first()["reply"] == "0.7"
    calls = iter([ValueError("down")])

    def down():
        raise next(calls, ValueError("still down"))

    replies.register("down")(down)
    assert replies.describe("down")["available"] is False and replies.describe("silent")["available"] is True


def test_forecast_with_a_model_and_without(spark):
    """The metrics are those of the ranked answers; a model that keeps everything still leads to ranked answers."""
    import random

    rng = random.Random(6)
    f = facts(spark, [(rng.choice("abcd"), rng.choice("xyz"), rng.choice("abcd"), rng.randrange(60)) for _ in range(150)])
    row = forecast.stability(f, {"model": forecast.Settings(provider="agreeable")}).first()
    assert row["settings"] == "model" and 0 < row["mrr"] <= 1 and row["queries"] == 15
    _, ranked, metrics = forecast.forecast(f)
    split = sorted((d, i) for i, (s, r, o, d) in enumerate([(x["subject"], x["relation"], x["object"], x["day"]) for x in f.orderBy("row_id").collect()]))[135:]
    truth = {i: f.where(F.col("row_id") == i).first()["object"] for _, i in split}
    lists = {}
    for r in ranked.collect():
        lists.setdefault(r["query_id"], {})[r["entity"]] = r["rank"]
    mrr = np.mean([1 / lists[q].get(o, len(lists[q]) + 1) if q in lists else 0 for q, o in truth.items()])
    assert metrics.first()["mrr"] == pytest.approx(mrr, abs=1e-6)


def test_texts(spark):
    p = "array<struct<subject:string,relation:string,object:string,day:long>>"
    df = spark.createDataFrame([([("b", "x", "a", 5), ("a", "y", "c", 2)],)], f"path {p}")
    got = df.select(names.path_range(F.col("path")).alias("r"), names.path_entities(F.col("path")).alias("e")).first()
    assert tuple(got["r"]) == (2, 5, 3) and got["e"] == ["a", "b", "c"]


def test_questions_without_history_use_no_facts_after(spark):
    f = facts(spark, ROWS)
    q = spark.createDataFrame([(1, "a", "x", 3)], "query_id long, subject string, relation string, day long")
    r = spark.createDataFrame([(1, ["x", "x"])], "rule_id long, body array<string>")
    assert [(x["object"], list(x["days"])) for x in reasoning.chains(f, q, r, 2).collect()] == [("c", [1, 2])]
