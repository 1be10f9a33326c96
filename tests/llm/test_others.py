"""Archives, the co-trained classifier and the pipeline."""

import io
import random
import zipfile

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from factline.llm import cotraining, warc


def test_archives(spark):
    rng = random.Random(2)
    big = ["é" * 600, "b" * 1000, "c" * 999, "d" * 5000]
    rows = [(i, f"http://x/{i}", rng.choice([*big, None, "", f"own {i} " * 200])) for i in range(60)] + [(60, None, "b" * 1000), (61, "http://odd/ a\n", big[0])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect())
    assert got == sorted(plain.warc([(p, h) for p, _, h in rows]))
    assert warc.round_trip(df.where("false")).count() == 0


def test_urls_with_line_separators(spark):
    """Only a line feed ends a line of the index."""
    rows = [(i, f"http://x/{c}/{i}", f"page {i}") for i, c in enumerate("\u2028\u2029\x85\x0b\x1e\n")]
    got = warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r["page_id"] for r in got) == list(range(6))
    assert {r["url"] for r in got if r["page_id"] < 3} == {r[1] for r in rows[:3]}


def test_zip64_and_comments():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open("archive/a", "w", force_zip64=True) as m:
            m.write(b"first")
        z.writestr("indexes/b", b"second")
        z.comment = b"a comment PK"
    data = out.getvalue()
    read = lambda offset, length: data[offset : offset + length]
    members = warc.zip_members(read, len(data))
    assert {n: read(o, s) for n, (o, s, m) in members.items() if m == 0} == {"archive/a": b"first", "indexes/b": b"second"}
    # the same directory behind a ZIP64 end record
    import struct

    end = data.rfind(b"PK\x05\x06")
    entries, length, offset = struct.unpack("<HLL", data[end + 10 : end + 20])
    record = b"PK\x06\x06" + struct.pack("<QHHLLQQQQ", 44, 45, 45, 0, 0, entries, entries, length, offset)
    wide = data[:end] + record + b"PK\x06\x07" + struct.pack("<LQL", 0, end, 1) + b"PK\x05\x06" + struct.pack("<HHHHLLH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    assert warc.zip_members(lambda o, n: wide[o : o + n], len(wide)) == members
    with pytest.raises(ValueError, match="central"):
        warc.zip_members(lambda o, n: b"", 0)


def test_damaged_record_is_noticed():
    record = warc.warc_record(1, "u", b"payload", "00" * 20, None)
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(record)


def test_held_out_accuracy(spark):
    """Rows beyond the labelled ones: junk has symbols, good text has none; the metadata view knows the source."""
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        words = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) + ("" if good else "###") for _ in range(30))
        rows.append((i, words if i % 50 else None, "en", f"s{rng.randrange(3) if good else rng.randrange(2, 5)}", len(words)))
        if i < 500:
            labels.append((i, int(good), None))
        else:
            labels.append((-i, int(good), 1))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in cotraining.classify(docs, table).collect()}
    held = [i for i in range(500, 900) if i % 50]
    truth = {-d: q for d, q, _ in labels if d < 0}
    assert np.mean([(got[i]["quality_score"] >= 0.5) == bool(truth[i]) for i in held]) > 0.97
    assert np.mean([(got[i]["quality_metadata"] >= 0.5) == bool(truth[i]) for i in held]) > 0.6
    assert len(got) == 900
    none = cotraining.classify(docs, table.where("false")).collect()
    assert {(r["quality_score"], r["quality_above"]) for r in none} == {(0.5, True)}
    assert cotraining.classify(docs.where("false"), table).count() == 0


def made_documents(n, labelled, seed=4):
    """Rows of (doc_id, text, lang, source, n_chars) and labels (doc_id, quality): junk has odd words and other sources."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        words = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"] if good or rng.random() < 0.6 else ["omega", "sigma"]) + str(rng.randrange(9)) for _ in range(12))
        rows.append((i, words, rng.choice(["en", None]), f"s{rng.randrange(3) if good else rng.randrange(2, 5)}", len(words)))
        if i < labelled:
            labels.append((i, int(good)))
    return rows, labels


COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_co_training_against_a_plain_version(spark):
    rows, labels = made_documents(260, 120)
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    got = {r["doc_id"]: r for r in cotraining.classify(docs, spark.createDataFrame(labels, "doc_id long, quality int"), rounds=2, handed=0.3, rows=10_000).collect()}
    drawn = [r[0] for r in spark.range(120).select(F.col("id").alias("doc_id")).orderBy(F.xxhash64("doc_id", F.lit(6)), "doc_id").collect()]
    columns = list(zip(*rows))
    dense = []
    for x, n in ((cotraining.content([t.encode() for t in columns[1]]), cotraining.COLUMNS[0]), (cotraining.metadata(*map(list, columns[2:])), cotraining.COLUMNS[1])):
        used, place = np.unique(x.column, return_inverse=True)
        m = np.zeros((x.n, len(used)))
        np.add.at(m, (x.row, place), x.value.astype("f4"))
        dense.append(m)
    one, two, both, threshold = plain.co_training(dense, {d: dict(labels)[d] for d in drawn}, 2, 0.3)
    for i in range(260):
        assert np.allclose([got[i]["quality_content"], got[i]["quality_metadata"], got[i]["quality_score"]], [one[i], two[i], both[i]], atol=1e-4)
        assert abs(both[i] - threshold) < 1e-4 or got[i]["quality_above"] == (both[i] >= threshold)


def test_rows_are_taken_as_often_as_asked():
    x = cotraining.content([b"a b", b"c", b"d e f"])
    twice = x.take(np.array([2, 0, 2]))
    weights = np.arange((1 << cotraining.BITS) + cotraining.SHAPES, dtype=float)
    assert np.allclose(twice.times(weights), x.times(weights)[[2, 0, 2]])


def test_classifier_with_repeats_nulls_and_other_columns(spark):
    """Labels of absent documents, far more than present ones, repeated ids, null metadata, columns named as results."""
    rows, labels = made_documents(300, 150)
    docs = spark.createDataFrame([(*r, 1, 0.5) for r in rows] + [(7, "again", None, None, None, 1, 0.5)] * 40 + [(None, None, None, None, None, 1, None)], COLUMNS + ", y int, quality_score double")
    table = spark.createDataFrame([(*x, "t") for x in labels] + [(10**6 + i, i % 2, "t") for i in range(20_000)] + [(None, 1, "t"), (3, None, "t")], "doc_id long, quality int, text string")
    plainly = {r["doc_id"]: r["quality_score"] for r in cotraining.classify(spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    got = cotraining.classify(docs, table, labelled=200).collect()
    assert len(got) == 341 and all(0 <= r["quality_score"] <= 1 for r in got)
    truth = dict(labels)
    right = lambda scores: np.mean([(s >= 0.5) == truth[d] for d, s in scores if d in truth])
    assert right([(r["doc_id"], r["quality_score"]) for r in got]) > 0.9 and right(plainly.items()) > 0.9
    views = docs.select("doc_id", F.col("text").cast("binary"), "lang", "source", "n_chars")
    assert cotraining.features(views, [7, 8, 8])[0] == [7, 8]


def test_features_on_the_driver_are_bounded(spark):
    """The first of the wanted rows that fit come, whole; a draw that fits is not changed by the bound."""
    words = lambda n: " ".join(f"w{k}" for k in range(n))
    docs = spark.createDataFrame([(i, words(100 * (i + 1)), "en", "s", 1) for i in range(6)], COLUMNS).withColumn("text", F.col("text").cast("binary"))
    assert cotraining.features(docs, [5, 0, 9, 1], 800)[0] == [0, 5]  # 608 and 108 and 208 features
    found, a, b = cotraining.features(docs, [5, 0, 9, 1], 10**6)
    assert found == [0, 1, 5] and len(a.value) == 924 and b.n == 3
    assert cotraining.features(docs, [5, 0], 600)[0] == [] and cotraining.features(docs, [], 600)[0] == []
    rows, labels = made_documents(300, 200)
    docs, table = spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(labels, "doc_id long, quality int")
    got = cotraining.classify(docs, table, entries=2000).collect()  # about 19 features a row: half of the labels
    truth = dict(labels)
    assert len(got) == 300 and np.mean([(r["quality_score"] >= 0.5) == truth[r["doc_id"]] for r in got if r["doc_id"] in truth]) > 0.9


def test_archive_edges(spark):
    """Very long pages, null page_ids, and columns named as results."""
    rows = [(1, "u", "x" * 3_000_000, "a"), (2, "u", "x" * 3_000_000, "b"), (None, "v", "y" * 2000, "c"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.round_trip(df).collect()), key=str)
    assert got == sorted([(1, 3_000_000, "revisit", 2), (2, 3_000_000, "response", None), (None, 2000, "response", None), (None, 0, "response", None)], key=str)


def test_packages_of_other_attempts_are_not_read(spark, tmp_path):
    df = spark.createDataFrame([(i, f"u{i}", f"page {i}") for i in range(10)], "page_id long, url string, html string").coalesce(1)
    uri = f"file://{tmp_path}/warc"
    first, second = (warc.write_packages(warc.with_types(df), uri).collect() for _ in range(2))
    assert {r["path"] for r in first}.isdisjoint(r["path"] for r in second)
    listed = spark.createDataFrame(second, "path string, records long, bytes long")
    assert warc.read_records(warc.record_ranges(listed, uri), uri, 2).count() == 10
    assert warc.file_system(uri)[1] == f"{tmp_path}/warc"


def test_pipeline_of_no_documents(spark, nothing, tmp_path):
    import corpus_pipeline as cp

    nothing.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark, docs, texts, tmp_path):
    import corpus_pipeline as cp

    docs.write.parquet(str(tmp_path / "documents.parquet"))
    item = " ".join(texts[2].split()[:12])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    here = [(r["doc_id"], r["text"]) for r in docs.collect()]
    current = docs
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, current, str(tmp_path)).cache()
        assert out.columns == docs.columns
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        if name == "quality":
            assert all(not plain.quality(t)[5] for t in rows.values())
        if name == "near_duplicates":
            assert set(rows) == {c for _, c in plain.components(here).values()}
        if name == "decontamination":
            assert all(plain.contamination(t, [(1, item)])[1] == 0 for t in rows.values())
        if name == "personal_data":
            assert all(plain.personal(t)[:4] == (0, 0, 0, 0) for t in rows.values())
        here, current = list(rows.items()), out
    final = cp.run(spark, str(tmp_path))
    assert {r["doc_id"] for r in final.collect()} == {k for k, _ in here}
    sizes = {r["doc_id"]: r["size"] for r in final.collect()}
    assert sizes == {k: len(plain.SPACED.findall(t)) for k, t in here}
