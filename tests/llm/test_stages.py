"""Stages on tables with repeated and null ids, and with columns named as results or as helpers."""

import pytest

import corpus_pipeline as cp
from factline.llm import jaccard

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
OTHER = "quite another text that has nothing at all in common with what the first one says about numbers"


def one_of_each(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, node string, n long").repartition(3)
    out = jaccard.keep_one(df)
    assert out.columns == df.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


def test_one_row_of_each_group_stays(spark):
    same = [(1, LONG), (1, LONG), (1, LONG), (None, LONG), (None, LONG), (2, LONG)]
    assert one_of_each(spark, [(*r, "x", 1) for r in same]) == [(2, LONG)]
    assert one_of_each(spark, [(None, LONG, "x", 1)] * 3) == [(None, LONG)]
    assert one_of_each(spark, [(7, LONG, "x", 1)] * 3) == [(7, LONG)]
    near = LONG + " seventeen"
    mixed = [(5, LONG), (3, near), (4, OTHER), (9, None), (None, ""), (6, OTHER), (6, OTHER), (8, near), (8, OTHER + " more words of its own here and there and everywhere")]
    # 4 stands for both rows of 6, 3 for the rest; texts without words link with nothing; 8's second text is its own
    assert one_of_each(spark, [(*r, "x", 1) for r in mixed]) == sorted([(3, near), (4, OTHER), (9, None), (None, ""), mixed[-1]], key=str)


ODD = "doc_id long, text string, lang string, source string, n_chars long, q7_alive string, kept boolean, pii_text string, pii_id string, own0 string, hit_at long, size long, row long"


@pytest.fixture()
def odd(spark):
    text = LONG + " mail someone@example.com or another.person@example.org and more words after that to fill the text"
    rows = [(1, text, "en", None, 5, "q", False, "p", "i", "o", 1, 2, 3), (1, OTHER + " again and again", "en", None, 5, "q", True, "p", "i", "o", 1, 2, 3), (None, None, None, "s", None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, ODD)


@pytest.mark.parametrize("stage", ["quality", "near_duplicates", "decontamination", "personal_data"])
def test_columns_stay(spark, odd, tmp_path, stage):
    spark.createDataFrame([(None, LONG), (None, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = dict(cp.STAGES)[stage](spark, odd, str(tmp_path))
    assert out.schema.simpleString() == odd.schema.simpleString()
    got, had = {r["text"]: r for r in out.collect()}, {r["text"]: r for r in odd.collect()}
    rest = [c for c in odd.columns if c not in ("text", "n_chars")]
    unchanged = [t for t in got if t in had]
    assert all(got[t] == had[t] for t in unchanged) and OTHER + " again and again" in got
    assert all([r[c] for c in rest] in [[h[c] for c in rest] for h in had.values()] for r in got.values())
    if stage == "personal_data":
        assert len(got) == 3 and any(t and "<email>" in t and "@" not in t for t in got)
    if stage == "quality":
        assert None not in got and len(got) == 2
    if stage == "decontamination":
        assert not any(t and LONG in t for t in got)


def test_mixture_of_null_sources_and_repeated_ids(spark, odd, tmp_path):
    out = cp.mixture(spark, odd, str(tmp_path)).collect()
    assert {(r["doc_id"], r["text"]) for r in out} == {(r["doc_id"], r["text"]) for r in odd.collect()}
