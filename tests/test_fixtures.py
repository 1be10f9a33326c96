"""Small hand-made facts with known answers."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from factline.functions import groups, names, temporal
from factline.operators import lookup, paths, reasoning, rules
from factline.sources import facts as sources


def facts(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "row_id long, subject string, relation string, object string, day long")
    return df.withColumn("ts", F.date_from_unix_date(F.col("day").cast("int")))


def test_first_after_tie(spark):
    f = facts(spark, [("a", "x", "b", 1), ("b", "y", "c", 1), ("b", "y", "d", 2), ("b", "y", "e", 2)])
    q = spark.createDataFrame([(1, "a", "y", 9)], "query_id long, subject string, relation string, day long")
    r = spark.createDataFrame([(1, ["x", "y"])], "rule_id long, body array<string>")
    got = reasoning.chains(f, q, r, 2).collect()
    assert [(x["object"], list(x["days"])) for x in got] == [("d", [1, 2])]


@pytest.mark.parametrize(
    ("rows", "body", "want"),
    [([("s", "x", "o", 1), ("s", "h", "o", 2)], ("x",), (1, 1)), ([("s", "x", "o", 1), ("s", "h", "o", 2), ("s", "y", "o", 3)], ("x", "y"), (1, 1))],
)
def test_confidence_cases(spark, rows, body, want):
    assert tuple(rules.confidence(facts(spark, rows), body, "h", 30).collect()[0]) == want


def plain_confidence(rows, body, head, validity):
    b = hb = 0
    pairs = {}
    for i, (s, r, o, d) in enumerate(rows):
        pairs.setdefault((s, o), []).append((d, i, r))
    n = len(body)
    for q in pairs.values():
        q.sort()
        for i in range(len(q)):
            part = q[i:]
            matched = hit = False
            if len(part) > n and tuple(x[2] for x in part[:n]) == body and part[n][0] - part[0][0] <= validity:
                matched, hit = True, part[n][2] == head
            else:
                days, k = [], 0
                for d, _, r in part:
                    if k < n and r == body[k]:
                        days.append(d)
                        k += 1
                if k == n and days[-1] - days[0] <= validity:
                    matched, hit = True, any(x[2] == head for x in part)
            b += matched
            if hit:
                hb += 1
                break
    return b, hb


@pytest.mark.parametrize("seed", range(4))
def test_confidence_against_plain(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.choice("xyh"), rng.choice("pq"), rng.randrange(12)) for _ in range(60)]
    f = facts(spark, rows)
    for body in (("x",), ("x", "y"), ("x", "y", "x")):
        assert tuple(rules.confidence(f, body, "h", 4).collect()[0]) == plain_confidence(rows, body, "h", 4)


def test_coverage_leaves_out_the_last_window(spark):
    assert rules.coverage(facts(spark, [("a", "x", "b", 1), ("a", "y", "b", 2)]), ("x", "y"), 5).collect()[0]["b_total"] == 0


@pytest.mark.parametrize("seed", range(2))
def test_coverage_against_plain(spark, seed):
    rng = random.Random(seed)
    rows = [("a", rng.choice("xy"), "b", rng.randrange(40)) for _ in range(80)]
    order = sorted((d, i, r) for i, (_, r, _, d) in enumerate(rows))
    hits = [order[i + 2][0] - order[i][0] for i in range(len(order) - 3) if [x[2] for x in order[i : i + 3]] == ["x", "y", "x"]]
    got = rules.coverage(facts(spark, rows), ("x", "y", "x"), 2).collect()[0]
    assert (got["b_valid"], got["b_total"]) == (sum(h <= 2 for h in hits), len(hits))


def test_alpha_misses_and_eviction(spark):
    assert spark.range(1).select(reasoning.alpha(F.lit(3.0), F.lit(3.0))).collect()[0][0] == 0.5
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "query_id long, entity string, rank long")
    truth = spark.createDataFrame([(1, "z")], "query_id long, object string")
    loose, strict = reasoning.metrics(ranked, truth).collect()[0], reasoning.metrics(ranked, truth, strict=True).collect()[0]
    assert (loose["mrr"], loose["hit10"], strict["mrr"], strict["hit10"]) == (0.25, 1.0, 0.0, 0.0)
    r = spark.createDataFrame([(0.59, 0.60), (0.59, 0.59)], "priority double, cp double")
    assert [x["retained"] for x in rules.eliminated(r).collect()] == [True, False]


def test_dates_and_names(spark):
    df = spark.createDataFrame([("2023-02-29",), ("2024-02-29",), ("2014-04-31",), ("2014-13-01",)], "d string")
    assert [r[0] for r in df.select(temporal.clamp_date(F.col("d"))).collect()] == ["2023-02-28", "2024-02-29", "2014-04-30", "2014-13-01"]
    pairs = spark.createDataFrame([("a b", "a b"), ("a b", "a c"), ("x", "y"), ("patient_01", "patient_02")], "a string, b string")
    assert [round(r[0], 6) for r in pairs.select(names.name_similarity(F.col("a"), F.col("b"))).collect()] == [1.0, 0.5, 0.2, 0.6]
    assert spark.range(1).select(temporal.parse_day(F.lit("2014"))).collect()[0][0] == 16071


def test_all_semantic_groups(spark):
    rows = {r["relation"]: r["group"] for r in groups.group_table(spark).collect()}
    assert len(groups.GROUPS) == len(set(rows.values())) == 19 and len(rows) == groups.group_table(spark).count()
    assert (rows["确诊"], rows["接种疫苗"], rows["卫生监督"], rows["Consult"]) == ("med_infection", "med_drug", "med_admin", "diplomacy")


def test_full_width_commas_where_the_time_is_empty(spark):
    lines = ["s，r，o，2014-01-01,,,", "s，r，o，2014-01-01", "s,r，o，2014-01-01", "s，r,o,2014-01-01", "s，t,r,o,2014-01-01", "s，r，o，2014-01-01，more", "s，r,o，2014-01-01"]
    df = spark.createDataFrame(list(enumerate(lines)), "row_id long, line string")
    got = {r["row_id"]: (r["subject"], r["relation"], r["object"]) for r in sources.repair_lines(df).collect()}
    assert got == {0: ("s", "r", "o"), 1: ("s", "r", "o"), 2: ("s", "r", "o"), 4: ("s，t", "r", "o"), 5: ("s", "r", "o")}
    assert set(r["row_id"] for r in sources.repair_lines(df, full_width=False).collect()) == {4}


@pytest.mark.parametrize("seed", range(2))
def test_split_against_plain(spark, monkeypatch, seed):
    monkeypatch.setattr(lookup, "TAKEN", (0, 200_000)[seed])
    rng = random.Random(seed)
    n = rng.randint(5, 60)
    rows = [("a", "x", "b", rng.randrange(8)) for _ in range(n)]
    order = sorted(range(n), key=lambda i: (rows[i][3], i))
    want = {i: "train" if k < int(n * 0.8) else "valid" if k < int(n * (0.8 + 0.1)) else "test" for k, i in enumerate(order)}
    assert {r["row_id"]: r["split"] for r in lookup.time_split(facts(spark, rows)).collect()} == want
    assert {r["row_id"] for r in lookup.test_facts(facts(spark, rows)).collect()} == {i for i, x in want.items() if x == "test"}


def test_many_rules_in_passes(spark, monkeypatch):
    """Rules judged together, in passes of two, are judged as each alone."""
    rng = random.Random(9)
    f = facts(spark, [(rng.choice("ab"), rng.choice("xyh"), rng.choice("pq"), rng.randrange(30)) for _ in range(80)])
    listed = [(1, ("x",), "h", 4.0), (2, ("x", "y"), "h", 9.0), (3, ("y", "x", "y"), "h", 20.0), (4, ("h", "x"), "y", 5.0), (5, ("none",), "h", 5.0)]
    alone = {}
    for r in listed:
        alone |= {x["rule_id"]: x for x in rules.evaluate(f, [r]).collect()}
    monkeypatch.setattr(rules, "RULES_A_PASS", 2)
    assert {x["rule_id"]: x for x in rules.evaluate(f, listed).collect()} == alone and len(alone) == 5


@pytest.mark.parametrize("block", [64, 2])
def test_mean_distances_against_plain(spark, monkeypatch, block):
    monkeypatch.setattr(reasoning, "BLOCK_DAYS", block)
    rng = random.Random(block)
    rows = [("a", "x", "b", rng.randrange(3, 40)) for _ in range(120)]
    days = [1, 3, 17, 39, 50]
    q = spark.createDataFrame(list(enumerate(days)), "query_id long, day long")
    got = {r["query_id"]: (r["dr"], r["dg"]) for r in reasoning.mean_distances(facts(spark, rows), q, (6, 3)).collect()}
    for i, day in enumerate(days):
        past = [day - d for *_, d in rows if d <= day]
        want = tuple(sum(past[-n:]) / len(past[-n:]) if past else 10.0 for n in (6, 3))
        assert got[i] == pytest.approx(want)


def test_chains_against_plain(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abc"), rng.choice("xy"), rng.choice("abc"), rng.randrange(12)) for _ in range(40)]
    asked = [(i, rng.choice("abc"), rng.randrange(12)) for i in range(10)]
    q = spark.createDataFrame(asked, "query_id long, subject string, day long")
    r = spark.createDataFrame([(1, ["x", "y", "x"]), (2, ["y"])], "rule_id long, body array<string>")
    want = []
    for qi, s, day in asked:
        for rule, body in ((1, "xyx"), (2, "y")):
            for i, (a, rel, o, d) in enumerate(rows):
                if a != s or rel != body[0] or d > day:
                    continue
                at, days = o, [d]
                for step in body[1:]:
                    later = sorted((d2, j, o2) for j, (a2, r2, o2, d2) in enumerate(rows) if a2 == at and r2 == step and d2 > days[-1])
                    if not later or later[0][0] > day:
                        break
                    at, days = later[0][2], [*days, later[0][0]]
                else:
                    want.append((qi, rule, i, at, days))
    got = [(x["query_id"], x["rule_id"], x["start_row"], x["object"], list(x["days"])) for x in reasoning.chains(facts(spark, rows), q, r, 3).collect()]
    assert sorted(got) == sorted(want)


def plain_paths(rows, score, targets, heads=3, hops=2, most=50, best=5, seed=42):
    """Sampled paths as lists of row numbers, with their targets, by the number of their first fact and target."""
    draw = lambda *x: hashlib.md5(":".join(map(str, x)).encode()).hexdigest()
    out = {}
    for target, end in targets.items():
        first = sorted((i for i, (_, r, _, d) in enumerate(rows) if r == target and d < end), key=lambda i: (draw(seed, i), i))[:heads]
        for i in first:
            path, entity, at = [i], rows[i][0], rows[i][3]
            for hop in range(hops):
                found = sorted((j for j, (s, _, _, d) in enumerate(rows) if s == entity and at <= d < end), key=lambda j: (draw(seed + hop, j), j))[:most]
                worth = sorted(((-score[target, rows[j][1]] * math.exp(-0.1 * abs(rows[j][3] - end)), j) for j in found))[:best]
                if not worth:
                    continue
                weight = [math.exp(-w + worth[0][0]) for w, _ in worth]
                u, done = int(draw(seed + 100 + hop, i)[:8], 16) / 2**32, 0.0
                for (_, j), w in zip(worth, weight):
                    done += w / sum(weight)
                    if done >= u:
                        break
                path.append(j)
                entity, at = rows[j][2], rows[j][3]
            if len(path) >= 2:
                out[i] = (target, path)
    return out


def test_sampled_paths_and_their_rules_against_plain(spark):
    rng = random.Random(8)
    rows = [(rng.choice("abcde"), rng.choice("xyz"), rng.choice("abcde"), rng.randrange(50)) for _ in range(120)]
    pair = {(a, b): round(rng.random(), 3) for a in "xyz" for b in "xyz" if a <= b}
    score = pair | {(b, a): v for (a, b), v in pair.items()}
    targets = {"x": 40, "z": 30}
    table = spark.createDataFrame([(a, b, v) for (a, b), v in pair.items()], "relation_a string, relation_b string, score double")
    ends = spark.createDataFrame(list(targets.items()), "target string, target_day long")
    found = paths.sample_paths(facts(spark, rows), table, ends)
    want = plain_paths(rows, score, targets)
    assert {r["path_id"]: (r["target"], [x["row_id"] for x in r["path"]]) for r in found.collect()} == want
    vectors = {"x": [1.0, 0.0], "y": [0.6, 0.8], "z": [0.0, 1.0]}
    v = spark.createDataFrame(list(vectors.items()), "relation string, vector array<double>")
    cosine = lambda a, b: sum(p * q for p, q in zip(vectors[a], vectors[b]))
    good = {}
    for i, (target, path) in want.items():
        f = [rows[j] for j in path]
        near = [cosine(a[1], b[1]) for a, b in zip(f, f[1:])]
        smooth = any(0 < b[3] - a[3] < 365 for a, b in zip(f, f[1:]))
        quality = 0.5 * sum(near) / len(near) + 0.3 * smooth + 0.2 * len({x for a in f for x in (a[0], a[2])}) / (2 * len(f))
        if quality >= 0.3:
            good.setdefault(target, []).append((-quality, i))
    kept = {i for xs in good.values() for _, i in sorted(xs)[:10]}
    judged = paths.validated(found, v)
    assert {r["path_id"] for r in judged.collect()} == kept
    mined = {}
    for i in sorted(kept):
        target, path = want[i]
        mined.setdefault((target, tuple(rows[j][1] for j in path[:-1])), i)
    assert {(r["head"], tuple(r["body"])): r["rule_id"] for r in rules.rules_of_paths(judged).collect()} == mined


def test_saved_rules_history_and_questions(spark, tmp_path):
    r = spark.createDataFrame([(1, 0.9, 0.8, True), (2, 0.3, 0.2, False), (3, 0.5, 0.7, True)], "rule_id long, cp double, priority double, retained boolean")
    rules.save(r, str(tmp_path / "rules"))
    assert sorted(map(tuple, rules.load(spark, str(tmp_path / "rules")).collect())) == sorted(map(tuple, r.collect()))
    assert rules.load(spark, str(tmp_path / "none")) is None
    steps = rules.history_step(r, 1).unionByName(rules.history_step(r.where("retained"), 2))
    assert [tuple(x) for x in rules.history_summary(steps).collect()] == [(2, 1, 0.0)]
    assert rules.history_summary(steps.where("false")).count() == 0
    assert tuple(rules.statistics(r).first()) == (3, 0.3, 0.9, 0.2, 0.8)
    assert rules.longest_gap(r.where("false").select(F.lit(1).alias("gap"))).first()[0] == 30.0
    f = facts(spark, [("a", "x", "b", i) for i in range(50)])
    drawn = lookup.sampled_questions(lookup.time_split(f), 3)
    assert drawn.count() == 3 and {tuple(x) for x in drawn.collect()} == {tuple(x) for x in lookup.sampled_questions(lookup.time_split(f), 3).collect()}
    assert lookup.history(f, -5, 7).count() == 7 and lookup.history(f, 9).count() == 10


def test_repaired_lines(spark, tmp_path):
    lines = ["subject,relation,object,timestamp", "Barack_Obama,Make_a_visit,South_Korea,2014-12-09", "A,Engage, negotiate,B,2014-01-02", "甲，确诊，乙，2022-12-20", "A,r,B,2014/01/02", "A,r,B,2023-02-29", "A,,B,2014-01-02", "A,r,B, C,2014-01-02"]
    want = {("Barack_Obama", "Make_a_visit", "South_Korea"), ("A", "Engage,negotiate", "B"), ("甲", "确诊", "乙"), ("A", "r,B", "C")}
    for name in ("utf-8", "gb18030"):
        path = tmp_path / f"{name}.csv"
        path.write_bytes("\n".join(lines).encode(name))
        got = sources.read_csv(spark, str(path))
        assert {(r["subject"], r["relation"], r["object"]) for r in got.collect()} == want
    assert sources.load(spark, str(tmp_path / "utf-8")).count() == 4
    with pytest.raises(FileNotFoundError):
        sources.load(spark, str(tmp_path / "none"))


def test_encoding_of_the_whole_input(spark, tmp_path):
    """The only lines that are not ASCII stand behind the first megabyte, or in one file of several."""
    plain = b"subject,relation,object,timestamp\n" + b"A,r,B,2014-01-02\n" * 70_000
    late = "甲,确诊,乙,2022-12-20\n"
    (tmp_path / "late.csv").write_bytes(plain + late.encode("gbk"))
    assert sources.probe_encoding(spark, str(tmp_path / "late.csv")) == "gbk"
    got = sources.load(spark, str(tmp_path / "late")).where("subject <> 'A'").collect()
    assert [(r["subject"], r["relation"], r["object"]) for r in got] == [("甲", "确诊", "乙")]
    (tmp_path / "many").mkdir()
    (tmp_path / "many/a.csv").write_bytes(plain)
    (tmp_path / "many/b.csv").write_bytes(late.encode("gbk"))
    assert sources.probe_encoding(spark, str(tmp_path / "many")) == "gbk"
    (tmp_path / "utf.csv").write_bytes(plain + late.encode())
    assert sources.probe_encoding(spark, str(tmp_path / "utf.csv")) == "utf-8"
    (tmp_path / "empty.csv").write_bytes(b"")
    assert sources.probe_encoding(spark, str(tmp_path / "empty.csv")) == "utf-8"


def test_turtle_times_carry_over(spark, tmp_path):
    (tmp_path / "f.ttl").write_text('@prefix yago: <http://example/> .\nyago:Z yago:knows yago:D ;\nyago:A yago:worksAt yago:B ;\n  yago:hasTime "2014-03-01" .\nyago:C yago:knows yago:D ;\n')
    got = sources.load(spark, str(tmp_path / "f")).orderBy("row_id").collect()
    assert [(r["subject"], str(r["ts"])) for r in got] == [("Z", "2014-01-01"), ("A", "2014-03-01"), ("C", "2014-03-01")]


def test_graph_round_trip(spark, tmp_path):
    f = facts(spark, [("a", "x", "b", 1), ("b", "y", "c", 2)])
    sources.write_graph(f, str(tmp_path / "g"))
    assert spark.read.parquet(str(tmp_path / "g/nodes")).count() == 3
    assert {r["type"] for r in spark.read.parquet(str(tmp_path / "g/edges")).collect()} == {"x", "y"}
    assert sorted(map(tuple, sources.read_graph(spark, str(tmp_path / "g")).select(*f.columns).collect())) == sorted(map(tuple, f.collect()))
    assert sources.triples(f).count() == 10 and sources.turtle_lines(f).count() == 2


def test_split_of_an_empty_table(spark):
    assert lookup.time_split(facts(spark, [("a", "x", "b", 1)]).where("false")).count() == 0


def test_providers(spark):
    from factline.operators import replies

    prompts = spark.createDataFrame([(1, "rate 0.7"), (2, "nothing")], "query_id long, prompt string")
    got = {(r["query_id"], r["vote"]): r["reply"] for r in replies.ask(prompts, "echo_number", votes=2).collect()}
    assert got == {(1, 0): "0.7", (1, 1): "0.7", (2, 0): None, (2, 1): None}
    assert "silent" in replies.provider_names()
