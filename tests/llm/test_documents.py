"""Operators on documents against plain Python versions, on texts with nulls, copies, long runs and odd characters."""

import random
import time

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from factline.llm import decontaminate, jaccard, licenses, lm_score, mixing, pii, quality_rules, secrets
from factline.llm.text import running

ESTIMATES = quality_rules.Estimates({}, [])


def by_doc(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


def test_licenses(docs, by_id):
    got = by_doc(licenses.scan(docs), "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert got == {k: plain.licenses(t) for k, t in by_id}


def test_licenses_by_the_method(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this fine software and associated documentation files (the Software), to deal in the Software without restriction"
    df = spark.createDataFrame([(1, mit), (2, "GNU General Public License, version 3"), (3, "permission is hereby granted")], "doc_id long, text string")
    got = by_doc(licenses.scan(df), "labels", "base_labels", "score")
    assert got[1][:2] == ("mit", "") and 0.8 <= got[1][2] < 1
    assert got[2][0] == "gpl-3" and got[3][0] == "" and 0 < got[3][2] < 0.8


def test_repeated_phrases_are_no_license(spark):
    """A template position counts once in a span, and spans do not grow along a chain of neighbouring diagonals."""
    bsd = licenses.FURTHER[2].text
    rows = [(1, "redistribution and use " * 25), (2, "permission is hereby granted " * 20), (3, f"{bsd} {bsd}"), (4, bsd.replace("binary forms", "binary and other forms"))]
    # half of the template's grams on each of two diagonals that lie further apart than the slack
    words = bsd.split()
    rows.append((5, " ".join(words[:9] + ["x"] * 8 + words[9:])))
    got = by_doc(licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")), "labels", "n_spans")
    assert got == {1: ("", 0), 2: ("", 0), 3: ("bsd", 2), 4: ("bsd", 1), 5: ("", 0)}


def test_jaccard(docs, by_id):
    got = by_doc(jaccard.join(docs), "n_shingles", "component_id")
    assert got == plain.components(by_id)


@pytest.mark.parametrize(("growth", "small"), [(2, 6), (8, 12)])
def test_jaccard_of_small_sets_and_lists(spark, monkeypatch, growth, small):
    """Sets around the boundary between subsets and lists, in few and in more rounds."""
    monkeypatch.setattr(jaccard, "GROWTH", growth)
    rng = random.Random(11)
    rows = []
    for i in range(160):
        base = [f"{rng.randrange(6)}x{j}" for j in range(rng.randint(4, 24))]
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(base[: -1 - i % 3] + ["y"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard, "boundary", lambda sets: small)
    assert by_doc(jaccard.join(df), "n_shingles", "component_id") == plain.components(rows)


def test_small_sets_meet_in_their_keys():
    """Whatever the boundary, two linked sets share a key; checked on all pairs of random small sets."""
    rng = random.Random(12)
    sets = [np.array(sorted(rng.sample(range(1, 22), rng.randint(3, 20))), dtype=np.uint64) for _ in range(120)]
    sets += [np.array(sorted(set(s.tolist()) - {s[0]}), dtype=np.uint64) for s in sets[:60]]
    for small in (0, 5, 8, 12):
        keys = [set(jaccard.set_keys(s, s[: jaccard.prefix_length(len(s))], small)[0].tolist()) for s in sets]
        for i, a in enumerate(sets):
            for j in range(i):
                shared = len(np.intersect1d(a, sets[j]))
                if len(a) != shared and 100 * shared >= 75 * (len(a) + len(sets[j]) - shared):
                    assert keys[i] & keys[j]


def test_shared_boilerplate_is_not_compared(spark, monkeypatch):
    """All texts share a passage that is most of them, and a group of copies: few pairs are compared, none is lost."""
    rng = random.Random(13)
    common = " ".join(f"c{i}" for i in range(150))
    rows = [(i, common + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(60))) for i in range(120)]
    copy = " ".join(f"k{i}" for i in range(200)).split()
    for i in range(120, 200):
        words = list(copy)
        words[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(words)))
    compared = []

    def counted(pairs, sets, verify=jaccard.verified):
        compared.append(pairs.count())
        return verify(pairs, sets)

    monkeypatch.setattr(jaccard, "verified", counted)
    assert by_doc(jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")), "n_shingles", "component_id") == plain.components(rows)
    assert sum(compared) < 5 * len(rows)


def test_boundary_follows_cost(spark):
    rows = [(4, 500), (4, 600), (8, 50), (12, 9)]
    df = spark.createDataFrame([(n, c, [1]) for n, c in rows], "n int, scan_cost long, tokens array<long>")
    assert jaccard.boundary(df) == 8 and jaccard.boundary(df.where("n > 8")) == 0


def test_jaccard_keeps_one(docs, by_id):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {c for _, c in plain.components(by_id).values()}


@pytest.fixture(scope="module")
def benchmark(spark, texts):
    long = next(t for t in texts if t and 40 < len(t.split()) < 200)
    other = texts[5 + 0] if texts[5] else texts[6]
    items = [(1, " ".join(long.split()[5:25])), (2, "one two three"), (3, None), (4, "!!"), (10, " ".join(long.split()[8:24]).upper()), (11, other), (12, "mail a b"), (13, " ".join(f"nowhere{k}" for k in range(80)))]
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string"), items


#: All windows fit; only those that occur do; not even those.
BOUNDS = [decontaminate.BROADCAST_BYTES, 6000, 0]


def test_bounds_take_all_ways(docs, benchmark):
    found = decontaminate.windows(benchmark[0])
    few = decontaminate._occurring(docs, found)
    assert 0 < decontaminate.packed_bytes(few) < BOUNDS[1] < decontaminate.packed_bytes(found)


@pytest.mark.parametrize("most", BOUNDS)
def test_decontamination(docs, by_id, benchmark, most):
    table, items = benchmark
    got = by_doc(decontaminate.scan(docs, table, most=most), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert got == {k: plain.contamination(t, items) for k, t in by_id}


@pytest.mark.parametrize("most", BOUNDS)
def test_decontamination_removes(docs, by_id, benchmark, most):
    table, items = benchmark
    out = decontaminate.remove(docs, table, most=most)
    assert out.columns == docs.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    for k, t in by_id:
        n, hit, *_ = plain.contamination(t, items)
        if not hit:
            assert got[k] == t
        elif hit > n / 2:
            assert k not in got
        else:
            assert len(plain.words(got[k])) == n - hit


def test_empty_benchmark(docs):
    """No item, or none with a word: nothing is hit, on either way."""
    for items in ([], [(1, None), (2, "!!")]):
        table = docs.sparkSession.createDataFrame(items, "item_id long, text string")
        for most in (decontaminate.BROADCAST_BYTES, -1):
            got = decontaminate.scan(docs, table, most=most)
            assert got.where("contaminated or n_hit > 0 or n_items > 0").count() == 0 and got.count() == docs.count()
            assert decontaminate.remove(docs, table, most=most).count() == docs.count()


def test_personal_data(docs, by_id):
    got = by_doc(pii.scan(docs), "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    assert got == {k: plain.personal(t) for k, t in by_id}


def test_personal_data_learns_contexts(spark):
    rng = random.Random(5)
    rows = [(i, f"please write to my mailbox user{i}@mail{i}.example.com today, filler words {rng.random()}") for i in range(40)]
    rows += [(100, "please write to my mailbox jo99812.home today"), (101, "unrelated token ab12345 stays")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_doc(pii.scan(df), "n_id", "spans")
    assert got[100][0] == 1 and got[101] == (0, "")
    out = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert out[100] == "please write to my mailbox <id> today" and out[101] == rows[-1][1] and "<email> today" in out[0]


def test_personal_data_learns_from_the_learned(spark):
    """Numbers beside e-mails are learned first, then the context that they share with a number of no such place."""
    rows = [(i, f"please write to my mailbox user{i}@mail{i}.example.com today") for i in range(150)]
    rows += [(200 + i, f"please write to my mailbox EMP-{10000 + i} today") for i in range(20)]
    rows += [(300 + i, f"he wore the badge number EMP-{10000 + i} then") for i in range(20)]
    rows += [(400, "he wore the badge number EMP-99123 then"), (401, "the order number ORD-77123 then")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = by_doc(pii.scan(df), "n_id")
    assert got[400] == (1,) and got[401] == (0,)
    assert {got[k] for k in got if 200 <= k < 400} == {(1,)}


def test_personal_data_with_less_than_two_words_before(spark):
    rows = [(i, f"mailto user{i}@mail{i}.example.com and user{i}@home{i}.example.com") for i in range(150)]
    rows += [(200, "mailto jo99812.home and others"), (201, "unrelated ab12345 stays")]
    got = by_doc(pii.scan(spark.createDataFrame(rows, "doc_id long, text string")), "n_id")
    assert got[200] == (1,) and got[201] == (0,)
    one = spark.createDataFrame([(1, "call A-12345 B-67890")], "doc_id long, text string")
    spans = pii.occurrences(one, ["doc_id"]).first()["pii_id"]
    assert [x["left"] for x in spans] == ["^ call", "call <id>"]


def test_personal_data_redacts(docs, by_id):
    out = pii.redact(docs)
    assert out.columns == docs.columns
    for r in out.collect():
        clean = plain.personal(dict(by_id)[r["doc_id"]])[:4] == (0, 0, 0, 0)
        assert (r["text"] == dict(by_id)[r["doc_id"]]) if clean else "<" in r["text"]
        assert r["n_chars"] == len(r["text"] or "")


def test_personal_data_in_long_contexts(spark):
    """A context word of 60 letters and one after 200 spaces are patterns as any other; a word of 400 is named by its hash."""
    word, longer = "w" * 60, "v" * 400
    rows = [(i, f"his {word} user{i}@mail{i}.example.com today") for i in range(150)]
    rows += [(200 + i, f"the {longer} user{i}@site{i}.example.com today") for i in range(150)]
    rows += [(400 + i, f"mailbox{' ' * 200}user{i}@home{i}.example.com") for i in range(150)]
    rows += [(600, f"his {word} jo99812.home"), (601, f"the {longer} jo99813.home"), (602, f"mailbox{' ' * 200}jo99814.home"), (603, "unrelated ab12345 stays")]
    got = by_doc(pii.scan(spark.createDataFrame(rows, "doc_id long, text string")), "n_id")
    assert [got[i] for i in range(600, 604)] == [(1,), (1,), (1,), (0,)]


def test_personal_data_of_texts_with_many_matches(spark, by_id):
    """20,000 addresses and as many other candidates in one text: right, and in seconds."""
    text = " ".join(f"user{i}@mail.example.com and x{i:06d} +1 319 555 {i % 9000 + 1000}" for i in range(20_000))
    began = time.perf_counter()
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert by_doc(pii.scan(df), "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == {1: plain.personal(text)}
    out = pii.redact(df).first()["text"]
    assert out.count("<email>") == 20_000 == out.count("<phone>") and "@" not in out and out.startswith("<email> and ")
    assert time.perf_counter() - began < 90


def test_running_folds(spark):
    rng = random.Random(3)
    rows = [([rng.randrange(-9, 9) for _ in range(n)],) for n in (0, 1, 63, 64, 65, 128, 1000)]
    df = spark.createDataFrame(rows, "v array<int>")
    got = df.select("v", running(F.col("v"), F.lit(0), lambda a, x: a + x).alias("s"), running(F.col("v"), F.lit(-99), lambda a, x: F.greatest(a, x)).alias("m")).collect()
    for r in got:
        assert r["s"] == [sum(r["v"][:i]) for i in range(len(r["v"]))] and r["m"] == [max(r["v"][:i], default=-99) for i in range(len(r["v"]))]


def test_columns_named_as_working_columns(docs):
    odd = docs.withColumn("pii_email", F.lit("x")).withColumn("q7_alive", F.lit(1)).withColumn("position", F.lit(2)).withColumn("key", F.lit("k")).withColumn("row", F.lit(1)).withColumn("hit_row", F.lit(1))
    assert pii.redact(odd).count() == docs.count() == quality_rules.cascade(odd, estimates=ESTIMATES).count() == mixing.mix(odd, carry=True).count()
    assert {"key", "row"} <= set(mixing.uses(odd, carry=True).columns)
    table = docs.select(F.col("doc_id").alias("item_id"), "text").limit(3)
    for most in (decontaminate.BROADCAST_BYTES, 0):
        assert decontaminate.remove(odd, table, most=most).columns == odd.columns


def test_secrets(docs, by_id):
    df = secrets.scan(docs)
    assert by_doc(df, "n_assign", "n_access", "n_hex", "base_sha256") == {k: plain.secrets(t) for k, t in by_id}
    spans = by_doc(df, "spans")
    key = next((k, t) for k, t in by_id if t and t.startswith("key Zx9"))
    random_ones = [s for s in spans[key[0]][0].split(",") if s.startswith("random")]
    assert random_ones == ["random:4:28"]


def test_random_runs_of_all_forms(spark):
    """Letters only, base32 without a digit, short ones, and one that signs cut; words, numbers and digests are none."""
    random_ones = ["qXzKvTbWpLmRdJhYcNfGsQaE", "KXWQZJVHTPBLMDRGFYNCXQZK", "Zx9Q7pLm2Kt8Vb4N", "aB3x9Lq$kL9vR2w!xZ2m.qW8t"]
    others = ["internationalization", "donaudampfschifffahrtsgesellschaft", "snake_case_identifier_name", "INTERNATIONALIZATION", "www.example.com.index.html", "v1.2.3-rc.4.5.6.7.8", "0054994038693466", "x!d41d8cd98f00b204e9800998ecf8427e", "someFunctionName.otherFunctionName"]
    df = spark.createDataFrame([(i, f"see {x} end") for i, x in enumerate(random_ones + others)], "doc_id long, text string")
    got = by_doc(secrets.scan(df), "spans")
    assert {k: [x for x in s[0].split(",") if x.startswith("random")] for k, s in got.items()} == {i: [f"random:4:{4 + len(x)}"] if i < len(random_ones) else [] for i, x in enumerate(random_ones + others)}


def test_many_secrets_take_linear_time(spark):
    """60,000 spans in one text: all found, in seconds (every pair compared took over an hour)."""
    key = "Zx9Q7pLm2Kt8Vb4Nc1Rd6Ws3"
    text = "".join(f"{key} password=abc{i:06d} " for i in range(30_000))
    began = time.perf_counter()
    got = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (got["n_assign"], got["n_random"]) == (30_000, 30_000) and time.perf_counter() - began < 60


def test_quality(docs, by_id):
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    df = quality_rules.cascade(docs, estimates=ESTIMATES, keep_measures=base).withColumn("base_failed", quality_rules.base_failed())
    got = by_doc(df, *base, "base_failed")
    assert got == {k: plain.quality(t) for k, t in by_id}
    assert df.where("kept and base_failed").count() == 0 and df.columns.count("kept") == 1


def test_quality_order_changes_no_verdict(docs):
    first = by_doc(quality_rules.cascade(docs, estimates=ESTIMATES), "kept")
    n = len(quality_rules.RULES)
    turned = quality_rules.Estimates({}, [tuple(j == i for j in range(n)) for i in range(n) for _ in range(i + 1)])
    assert quality_rules.order(quality_rules.RULES, turned) == list(reversed(quality_rules.RULES))
    judged = quality_rules.cascade(docs, estimates=turned)
    assert by_doc(judged, "kept") == first
    assert judged.where("kept").count() == sum(v[0] for v in first.values())
    # the guard keeps the optimizer from repeating the measures in the filter
    text = judged.where("kept")._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Lu}") == judged._jdf.queryExecution().optimizedPlan().toString().count("Lu}")


def test_quality_order_weighs_rejections_and_costs(docs):
    """Steps are charged once, rejections counted among the rows still alive."""
    rule = lambda name, *needs: quality_rules.Rule(name, needs, lambda: F.lit(False))
    rules = (rule("costly", "n_repeat_words"), rule("cheap", "n_symbols"), rule("same", "n_symbols"), rule("free", "n_words"))
    seconds = {"_words": 1.0, "_repeats": 8.0, "_symbols": 2.0}
    rows = [(True, False, False, False)] * 30 + [(False, True, True, False)] * 10 + [(False, False, True, True)] * 1
    names = lambda made=(): [r.name for r in quality_rules.order(rules, quality_rules.Estimates(seconds, rows), made)]
    assert names() == ["same", "costly", "cheap", "free"] or names() == ["same", "costly", "free", "cheap"]
    assert names(("n_repeat_words",))[0] == "costly"
    found = quality_rules.estimate(docs)
    assert set(found.seconds) == {"_words", "_word_chars", "_symbols", "_lines", "_repeats", "_letters"} and min(found.seconds.values()) > 0
    assert len(found.rejects) == docs.where("octet_length(text) <= 20000").count()


def test_mixing(docs, by_id):
    df = mixing.mix(docs)
    rows = {r["doc_id"]: r for r in df.collect()}
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    size = {k: len(plain.SPACED.findall(t or "")) for k, t in by_id}
    totals = {}
    for k, s in source.items():
        totals[s] = totals.get(s, 0) + size[k]
    want = plain.targets(totals)
    taken = dict.fromkeys(totals, 0)
    for k, r in rows.items():
        assert r["size"] == size[k] and r["source_size"] == totals[source[k]] and abs(r["target"] - want[source[k]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * size[k] and (r["position"] is None) == (r["taken"] == 0) == (r["last_position"] is None)
        taken[source[k]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 0.5 for s in totals)
    assert {k: r["taken"] for k, r in rows.items()} == {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(5)).collect()}


def test_mixing_positions_follow_the_schedule(spark):
    share = spark.createDataFrame([(0.0,), (0.25,), (1.0,)], "s double")
    got = [r[0] for r in share.select(mixing.position(F.col("s"), F.lit(1.5), F.lit(0.5))).collect()]
    for s, t in zip((0.0, 0.25, 1.0), got):
        assert abs(1.5 * t - 0.5 * t * t - s) < 1e-9


def test_mixing_places_every_use(spark):
    """Source b has the lower weight and is used twice: its second pass has positions after its first."""
    rows = [(i, "w " * (3 + i % 5), "a" if i < 300 else "b") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    each = mixing.uses(df).collect()
    assert [r["position"] for r in each] == sorted(r["position"] for r in each)
    target = {s: next(r["target"] for r in each if r["doc_id"] in ids) for s, ids in (("a", range(300)), ("b", range(300, 400)))}
    assert abs(sum(r["taken"] for r in each) - 1.5 * sum(3 + i % 5 for i in range(400))) <= 1 and all(r["taken"] > 0 for r in each)
    for name, ids in (("a", range(300)), ("b", range(300, 400))):
        of = sorted((r["position"], r["epoch"], r["taken"]) for r in each if r["doc_id"] in ids)
        assert [e for _, e, _ in of] == sorted(e for _, e, _ in of) and of[-1][1] == 1 and of[-1][0] > 0.95
        first, last = (1.5, 0.5) if name == "a" else (0.5, 1.5)
        done = 0
        for t, _, n in of:
            assert abs((first * t + (last - first) * t * t / 2) - done / target[name]) < 1e-6
            done += n
    whole = by_doc(mixing.mix(df), "taken", "position", "last_position")
    of = {k: [r for r in each if r["doc_id"] == k] for k in whole}
    ends = lambda rows, pick: pick((r["position"] for r in rows), default=None)
    assert {k: (sum(r["taken"] for r in v), ends(v, min), ends(v, max)) for k, v in of.items()} == whole


def test_backoff_scores(docs, by_id):
    want = plain.backoff(by_id)
    for r in lm_score.score(docs).collect():
        n, seen, s = want[r["doc_id"]]
        assert (r["n_words"], r["n_seen"]) == (n, seen) and abs(r["log_score"] - s) < 1e-6 * max(1, abs(s))


@pytest.mark.parametrize(
    "run",
    [licenses.scan, jaccard.join, lm_score.score, pii.scan, pii.redact, secrets.scan, quality_rules.cascade, mixing.mix, jaccard.keep_one, lambda d: decontaminate.scan(d, d.select(F.col("doc_id").alias("item_id"), "text"))],
)
def test_empty_tables(nothing, run):
    assert run(nothing).count() == 0


def test_repeated_rows(docs):
    twice = docs.union(docs)
    for run in (licenses.scan, secrets.scan, pii.scan, lambda d: quality_rules.cascade(d, estimates=ESTIMATES), jaccard.join, mixing.mix, lm_score.score):
        assert run(twice).count() == 2 * docs.count()


def test_several_texts_of_one_doc_id(spark):
    """Documents 3 and 7 are linked through the two texts of document 5."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(3, a + " x"), (5, a + " y"), (5, b + " y"), (7, b + " z"), (9, None), (None, a + " x")]
    got = sorted((tuple(r) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(3, 57, 3), (5, 57, 3), (5, 57, 3), (7, 57, 3), (9, 0, 9), (None, 57, 3)], key=str)
