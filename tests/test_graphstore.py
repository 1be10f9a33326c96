"""The bucketed graph: look-ups read one bucket, hops have no shuffle, and another session finds the tables again."""

import pytest
from pyspark.sql import functions as F

from factline.sources import graphstore

from test_replies import made_facts


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('graph')}"
    facts = made_facts(spark)
    return facts, path, graphstore.write_graph(facts, path, "one", 4)


def plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_look_ups_read_one_bucket(spark, graph, tmp_path):
    facts, _, _ = graph
    g = graphstore.write_graph(facts, f"file://{tmp_path}", "looked", 4)
    cases = ((graphstore.out_edges(g, "s3"), "outgoing", facts.where("subject = 's3'").select("relation", "object", "ts")), (graphstore.in_edges(g, "s3"), "incoming", facts.where("object = 's3'").select("subject", "relation", "ts")))
    for found, side, want in cases:
        files = [r[0] for r in found.select(F.input_file_name()).distinct().collect()]
        assert len(files) == 1
        for f in (tmp_path / side).glob("part-*"):
            if not files[0].endswith(f.name):
                f.write_bytes(b"whoever reads this fails")
                (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) != []


def test_a_hop_has_no_shuffle(spark, graph):
    facts, path, g = graph
    want = sorted((a["row_id"], b["row_id"]) for a in facts.where("relation = 'p'").collect() for b in facts.where("relation = 'q'").collect() if a["object"] == b["subject"] and a["day"] <= b["day"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for x in (g, graphstore.open_graph(spark, path, "another")):
            found = graphstore.hop(x, "p", "q")
            assert sorted((r["row1"], r["row2"]) for r in found.collect()) == want
            text = plan(found)
            assert "SortMergeJoin" in text and "Exchange" not in text, text
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_writing_again_replaces(spark, graph):
    facts, path, _ = graph
    g = graphstore.write_graph(facts.where("relation = 'p'"), path + "/again", "again", 4)
    g = graphstore.write_graph(facts.where("relation = 'q'"), path + "/again", "again", 2)
    assert {r["relation"] for r in g.outgoing.select("relation").distinct().collect()} == {"q"}
    assert g.incoming.count() == facts.where("relation = 'q'").count()
