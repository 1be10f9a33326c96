"""Registered queries over the events table as facts, each with equivalent DuckDB SQL where there is one.

Facts: subject u<user_id>, relation event_type, object u<k % 10> (k from props), day since 1970-01-01.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factline.functions import groups, names, temporal
from factline.operators import caserules, embed, graphmodel, incremental, lookup, paths, patterns, reasoning, replies, rules
from factline.plans import forecast
from factline.session import durable, shared_path
from factline.sources import facts as sources
from factline.sources import graphstore

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

FACTS_SQL = """facts AS (SELECT event_id AS row_id, 'u' || user_id AS subject, event_type AS relation,
  'u' || (CAST(json_extract_string(props, '$.k') AS BIGINT) % 10) AS object, CAST(ts AS DATE) AS ts,
  CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS BIGINT) AS day FROM events)"""
BODY, HEAD, CHAIN = ("click", "view"), "purchase", ("click", "view", "purchase")
RULES = ((1, ("click",), "purchase", 10.0), (2, ("click", "view"), "purchase", 20.0), (3, ("signup", "error"), "view", 15.0), (4, ("view",), "click", 5.0))
QUERY_DAY = 19742  # 2024-01-20


def query(sql: str | None = None, facts: bool = True):
    """Register a function of (spark, sf_dir), or of facts; `sql` may use the relation `facts`."""

    def add(f):
        name = f.__name__
        QUERIES[name] = (lambda spark, sf_dir: f(sources.from_events(spark, sf_dir))) if facts else f
        if sql:
            lead = "WITH " + FACTS_SQL if "facts" in sql else ""
            body = sql.strip()
            if lead and body.upper().startswith("WITH "):
                body = lead + ", " + body[5:]
            elif lead:
                body = lead + " " + body
            ORACLES[name] = body
        return f

    return add


def as_long(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("long") for c in columns})


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- case rules ------------------------------------------------------------------------------------------------------

RANK_SQL = """inst AS (SELECT subject, object, t2, count(*) AS n FROM bodies GROUP BY ALL),
sup AS (SELECT i.*, EXISTS (SELECT 1 FROM facts h WHERE h.relation = 'purchase' AND h.subject = i.subject AND h.object = i.object AND h.day > i.t2) AS supported FROM inst i),
sc AS (SELECT q.subject, q.t2, h.object AS cand, count(*) AS score FROM (SELECT DISTINCT subject, t2 FROM inst) q
  JOIN facts h ON h.relation = 'purchase' AND h.subject = q.subject AND h.day > q.t2 GROUP BY ALL),
own AS (SELECT s.*, coalesce(sc.score, 0.5) AS own FROM sup s LEFT JOIN sc ON s.subject = sc.subject AND s.t2 = sc.t2 AND s.object = sc.cand),
ranked AS (SELECT o.*, 1 + (SELECT count(*) FROM sc WHERE sc.subject = o.subject AND sc.t2 = o.t2 AND (sc.score > o.own OR (sc.score = o.own AND sc.cand < o.object))) AS rank FROM own o)"""
METRIC_SQL = """SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS matches, round(sum(CASE WHEN supported THEN n ELSE 0 END) / sum(n), 6) AS cond_acc,
  round(sum({w} * n / rank) / sum(n), 6) AS mrr, round(sum({w} * n * (rank <= 1)::INT) / sum(n), 6) AS hit1,
  round(sum({w} * n * (rank <= 3)::INT) / sum(n), 6) AS hit3, round(sum({w} * n * (rank <= 10)::INT) / sum(n), 6) AS hit10 FROM ranked"""
PAIR_BODIES = "bodies AS (SELECT a.subject, a.object, b.day AS t2 FROM facts a JOIN facts b ON a.subject = b.subject AND a.object = b.object AND a.day < b.day WHERE a.relation = 'click' AND b.relation = 'view')"
LOOP_BODIES = "bodies AS (SELECT object AS subject, object, day AS t2 FROM facts WHERE relation = 'click')"


@query(f"WITH {PAIR_BODIES}, {RANK_SQL} {METRIC_SQL.format(w='1.0')}")
def case_rule_metrics(facts):
    return as_long(caserules.evaluate(facts, caserules.body_instances(facts, *BODY), HEAD), "matches")


@query(f"WITH {PAIR_BODIES}, {RANK_SQL} {METRIC_SQL.format(w='(CASE WHEN supported THEN 1.0 ELSE 0.0 END)')}")
def case_rule_metrics_strict(facts):
    return as_long(caserules.evaluate(facts, caserules.body_instances(facts, *BODY), HEAD, unsupported_zero=True), "matches")


@query(f"WITH {LOOP_BODIES}, {RANK_SQL} {METRIC_SQL.format(w='1.0')}")
def selfloop_rule(facts):
    return as_long(caserules.evaluate(facts, caserules.instances(caserules.self_loop_matches(facts, "click")), HEAD), "matches")


@query("""SELECT b.t1, b.t2, count(*) AS bodies, CAST(sum(EXISTS (SELECT 1 FROM facts h WHERE h.relation = 'purchase' AND h.subject = b.subject AND h.object = b.object AND h.day > b.t2)::INT) AS BIGINT) AS supported
FROM (SELECT a.subject, a.object, a.day AS t1, b.day AS t2 FROM facts a JOIN facts b ON a.subject = b.subject AND a.object = b.object AND a.day < b.day WHERE a.relation = 'click' AND b.relation = 'view') b GROUP BY 1, 2""")
def case_rule_cond_acc(facts):
    found = caserules.body_matches(facts, *BODY)
    later = facts.where(F.col("relation") == HEAD).groupBy("subject", "object").agg(F.max("day").alias("last"))
    return found.join(later, ["subject", "object"], "left").groupBy("t1", "t2").agg(F.count("*").alias("bodies"), F.count_if(F.coalesce(F.col("last") > F.col("t2"), F.lit(False))).alias("supported"))


@query("SELECT subject, object, day AS t2 FROM facts f WHERE relation = 'click' AND EXISTS (SELECT 1 FROM facts h WHERE h.relation = 'purchase' AND h.subject = f.subject AND h.object = f.object AND h.day > f.day)")
def supported_bodies(facts):
    a = facts.where(F.col("relation") == "click").select("subject", "object", F.col("day").alias("t2"))
    h = facts.where(F.col("relation") == HEAD).groupBy(F.col("subject").alias("hs"), F.col("object").alias("ho")).agg(F.max("day").alias("last"))
    return a.join(h, (F.col("subject") == F.col("hs")) & (F.col("object") == F.col("ho")) & (F.col("last") > F.col("t2")), "left_semi")


@query("SELECT relation, count(*) AS n FROM facts WHERE regexp_matches(relation, 'i.*w|^p') GROUP BY relation")
def relation_search(facts):
    return caserules.relation_search(facts, "i.*w|^p")


@query("SELECT r AS relation, CAST(count(row_id) AS BIGINT) AS n FROM (VALUES ('click'), ('absent'), ('view')) v(r) LEFT JOIN facts ON relation = r GROUP BY r")
def relation_exists(facts):
    return as_long(caserules.existing(facts, ["click", "absent", "view"]), "n")


# --- lookups and profile ---------------------------------------------------------------------------------------------


@query("SELECT row_id, relation, object, ts FROM facts WHERE subject = 'u5'")
def facts_by_subject(facts):
    return lookup.matching(facts, subject="u5").select("row_id", "relation", "object", "ts")


@query("SELECT row_id, subject, object FROM facts WHERE subject = 'u5' AND relation = 'view'")
def facts_by_subject_relation(facts):
    return lookup.matching(facts, subject="u5", relation="view").select("row_id", "subject", "object")


@query("SELECT row_id, subject FROM facts WHERE relation = 'purchase' AND ts BETWEEN DATE '2024-01-05' AND DATE '2024-01-12'")
def facts_time_range(facts):
    return lookup.matching(facts, relation="purchase", between=("2024-01-05", "2024-01-12")).select("row_id", "subject")


@query("SELECT row_id, subject, object FROM facts WHERE relation = 'error' AND ts < DATE '2024-01-10' AND ts > DATE '2024-01-03' AND object = 'u3'")
def fact_conditions(facts):
    return lookup.matching(facts, relation="error", object_="u3", before="2024-01-10", after="2024-01-03").select("row_id", "subject", "object")


@query("SELECT subject, relation, ts FROM facts WHERE object = 'u5'")
def in_edges(facts):
    return lookup.in_edges(facts, "u5")


@query("SELECT relation, object, ts FROM facts WHERE subject = 'u5'")
def out_edges(facts):
    return lookup.out_edges(facts, "u5")


def _indexed(facts: DataFrame) -> graphstore.Graph:
    spark = facts.sparkSession
    path = shared_path(spark, "graph")
    return graphstore.write_graph(facts, path, path.rpartition("-")[2], 8)


@query("SELECT 'out' AS way, relation, object AS other, ts FROM facts WHERE subject = 'u5' UNION ALL SELECT 'in', relation, subject, ts FROM facts WHERE object = 'u5'")
def indexed_edges(facts):
    g = _indexed(facts)
    out = graphstore.out_edges(g, "u5").select(F.lit("out").alias("way"), "relation", F.col("object").alias("other"), "ts")
    return out.union(graphstore.in_edges(g, "u5").select(F.lit("in"), "relation", "subject", "ts"))


@query("SELECT a.row_id AS row1, b.row_id AS row2, a.subject, a.object AS via, b.object FROM facts a JOIN facts b ON a.object = b.subject AND a.day <= b.day WHERE a.relation = 'signup' AND b.relation = 'purchase'")
def indexed_hop(facts):
    return graphstore.hop(_indexed(facts), "signup", "purchase")


@query("SELECT relation, count(*) AS n, min(day) AS first_day, max(day) AS last_day, round(count(*) / (SELECT count(*) FROM facts), 6) AS share FROM facts GROUP BY relation")
def relation_share(facts):
    return lookup.relation_profile(facts)


@query("SELECT relation, count(*) AS n FROM facts GROUP BY relation ORDER BY n DESC, relation LIMIT 3")
def top_relations(facts):
    return facts.groupBy("relation").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "relation").limit(3)


@query("SELECT value, CAST(row_number() OVER (ORDER BY value) - 1 AS BIGINT) AS id FROM (SELECT subject AS value FROM facts UNION SELECT object FROM facts)")
def vocab_ids(facts):
    return as_long(lookup.vocabulary(facts, "subject", "object"), "id")


@query("""WITH p AS (SELECT *, row_number() OVER (ORDER BY day, row_id) - 1 AS pos, count(*) OVER () AS n FROM facts)
SELECT row_id, CASE WHEN pos < floor(n * 0.8::DOUBLE) THEN 'train' WHEN pos < floor(n * (0.8::DOUBLE + 0.1::DOUBLE)) THEN 'valid' ELSE 'test' END AS split FROM p""")
def time_split(facts):
    return lookup.time_split(facts).select("row_id", "split")


@query("SELECT count(*) AS facts, count(DISTINCT relation) AS relations, count(DISTINCT ts) AS times, min(ts) AS first, max(ts) AS last, (SELECT count(*) FROM (SELECT subject FROM facts UNION SELECT object FROM facts)) AS entities FROM facts")
def dataset_summary(facts):
    return lookup.summary(facts)


@query("SELECT name, CASE WHEN name = 'u1' THEN 'Person' WHEN name = 'u2' THEN 'Country' ELSE 'Entity' END AS kind FROM (SELECT subject AS name FROM facts UNION SELECT object FROM facts)")
def entity_types(facts):
    return lookup.entity_types(facts, facts.sparkSession.createDataFrame([("u1", "Person"), ("u2", "Country")], "name string, kind string"))


@query("SELECT name, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree FROM (SELECT subject AS name, 1 AS o, 0 AS i FROM facts UNION ALL SELECT object, 0, 1 FROM facts) GROUP BY name")
def graph_degree(facts):
    return lookup.degrees(facts)


@query("SELECT subject, relation, object, ts, min(row_id) AS row_id FROM facts WHERE subject <> object GROUP BY ALL")
def clean_facts(facts):
    return lookup.clean(facts)


# --- patterns --------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT relation AS r1, lead(relation) OVER w AS r2, lead(relation, 2) OVER w AS r3, lead(day, 2) OVER w - day AS span FROM facts WINDOW w AS (PARTITION BY subject, object ORDER BY day, row_id))
SELECT r1, r2, r3, count(*) AS n, round(avg(span), 6) AS mean_span FROM l WHERE r3 IS NOT NULL GROUP BY ALL ORDER BY n DESC, r1, r2, r3 LIMIT 6""")
def pair_chain_discovery(facts):
    return rounded(patterns.discover(facts), "mean_span")


@query("""WITH l AS (SELECT relation AS r1, lead(relation) OVER w AS r2, lead(relation, 2) OVER w AS r3, lead(day, 2) OVER w - day AS span FROM facts WINDOW w AS (PARTITION BY subject, object ORDER BY day, row_id)),
d AS (SELECT r1, r2, r3, count(*) AS n, avg(span) AS m FROM l WHERE r3 IS NOT NULL GROUP BY ALL ORDER BY n DESC, r1, r2, r3 LIMIT 6)
SELECT 'pattern_' || row_number() OVER (ORDER BY n DESC, r1, r2, r3) || '_' || r1 AS pattern, r1, r2, r3, n, greatest(7, least(365, CAST(trunc(2 * m) AS BIGINT))) AS validity_days FROM d""")
def pattern_catalogue(facts):
    return as_long(patterns.discovered_catalogue(facts), "validity_days")


TRIPLE_SQL = "FROM facts a JOIN facts b ON a.subject = b.subject AND a.object = b.object AND a.day <= b.day JOIN facts c ON a.subject = c.subject AND a.object = c.object AND b.day <= c.day WHERE a.relation = 'click' AND b.relation = 'view' AND c.relation = 'purchase'"


@query(f"SELECT a.subject, a.object, a.day AS t1, b.day AS t2, c.day AS t3, a.row_id AS row1, b.row_id AS row2, c.row_id AS row3 {TRIPLE_SQL}")
def pattern_same_pair(facts):
    return patterns.same_pair(facts, CHAIN)


@query(f"SELECT a.subject, a.object, a.day AS t1, b.day AS t2, c.day AS t3, a.row_id AS row1, b.row_id AS row2, c.row_id AS row3 {TRIPLE_SQL} AND c.day - a.day <= 10")
def pattern_within_validity(facts):
    return patterns.same_pair(facts, CHAIN, within=10)


@query("""SELECT a.subject, a.object, b.object AS intermediate, a.day AS t1, b.day AS t2, c.day AS t3, a.row_id AS row1, b.row_id AS row2, c.row_id AS row3
FROM facts a JOIN facts b ON a.subject = b.subject AND a.day <= b.day JOIN facts c ON b.object = c.subject AND a.object = c.object AND b.day <= c.day WHERE a.relation = 'click' AND b.relation = 'view' AND c.relation = 'purchase'""")
def pattern_cross_entity(facts):
    return patterns.cross_entity(facts, CHAIN)


@query(f"SELECT a.subject, a.object, a.day AS t1, b.day AS t2, arg_min(c.day, c.row_id) AS t3 {TRIPLE_SQL} GROUP BY ALL ORDER BY t1, t2, a.subject, a.object LIMIT 100")
def pattern_dedup_topn(facts):
    return patterns.first_matches(facts, CHAIN)


@query("""WITH f AS (SELECT * FROM facts WHERE relation IN ('click', 'view', 'purchase', 'signup', 'error'))
SELECT * FROM (SELECT 'one' AS pattern, a.subject, a.object, CAST(NULL AS VARCHAR) AS intermediate, a.day AS t1, b.day AS t2, c.day AS t3, 60 AS validity_days FROM facts a JOIN facts b ON a.subject = b.subject AND a.object = b.object AND a.day <= b.day JOIN facts c ON a.subject = c.subject AND a.object = c.object AND b.day <= c.day WHERE a.relation = 'signup' AND b.relation = 'error' AND c.relation = 'view')
UNION ALL SELECT 'two', a.subject, a.object, b.object, a.day, b.day, c.day, 90 FROM facts a JOIN facts b ON a.subject = b.subject AND a.day <= b.day JOIN facts c ON b.object = c.subject AND a.object = c.object AND b.day <= c.day WHERE a.relation = 'error' AND b.relation = 'view' AND c.relation = 'signup'""")
def pattern_batch(facts):
    return patterns.match_all(facts, (("one", ("signup", "error", "view"), 60, False), ("two", ("error", "view", "signup"), 90, True)))


@query("""SELECT a.row_id AS row1, b.row_id AS row2 FROM facts a JOIN facts b ON a.object = b.subject AND a.day <= b.day WHERE a.relation = 'signup' AND b.relation = 'purchase'""")
def chain_two_hop(facts):
    p = patterns.object_chain(facts, ("signup", "purchase"))
    return p.select(F.expr("path[0].row_id").alias("row1"), F.expr("path[1].row_id").alias("row2"))


# --- ingestion -------------------------------------------------------------------------------------------------------

LINES_SQL = """lines AS (SELECT row_id, CASE row_id % 7 WHEN 0 THEN subject || ',' || relation || ', later,' || object || ',' || ts WHEN 1 THEN subject || '，' || relation || '，' || object || '，' || ts
  WHEN 2 THEN subject || ',,' || object || ',' || ts WHEN 3 THEN subject || ',' || relation || ',' || object || ',2023-02-29' WHEN 4 THEN subject || ',' || relation || ',' || object || ',' || replace(ts::VARCHAR, '-', '/')
  ELSE ' ' || subject || ', ' || relation || ',' || object || ',' || ts END AS line FROM facts)"""


def _lines(facts: DataFrame) -> DataFrame:
    """Comma-separated lines with the faults that real files have."""
    s, r, o, t = "subject", "relation", "object", F.date_format("ts", "yyyy-MM-dd")
    join = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) and not v.isalpha() else (F.col(v) if isinstance(v, str) else v) for v in x])
    kind = F.col("row_id") % 7
    line = (
        F.when(kind == 0, join(s, ",", r, ", later,", o, ",", t)).when(kind == 1, join(s, "，", r, "，", o, "，", t)).when(kind == 2, join(s, ",,", o, ",", t))
        .when(kind == 3, join(s, ",", r, ",", o, ",2023-02-29")).when(kind == 4, join(s, ",", r, ",", o, ",", F.translate(t, "-", "/"))).otherwise(join(" ", s, ", ", r, ",", o, ",", t))
    )
    return facts.select("row_id", line.alias("line"))


@query(f"WITH {LINES_SQL} SELECT l.row_id, f.subject, CASE WHEN l.row_id % 7 = 0 THEN f.relation || ',later' ELSE f.relation END AS relation, f.object, f.ts, f.day FROM lines l JOIN facts f USING (row_id) WHERE l.row_id % 7 NOT IN (2, 3, 4)")
def csv_repair(facts):
    return sources.repair_lines(_lines(facts))


@query("""WITH t AS (SELECT row_id, subject, relation, object, CASE WHEN row_id % 3 = 0 THEN ts::VARCHAR END AS stamp FROM facts)
SELECT row_id * 2 AS row_id, subject, relation, object, CAST(coalesce(last_value(stamp IGNORE NULLS) OVER (ORDER BY row_id ROWS UNBOUNDED PRECEDING), '2014-01-01') AS DATE) AS ts FROM t""")
def turtle_scan(facts):
    name = lambda c: F.concat(F.lit("yago:"), c)
    first = F.concat(name("subject"), F.lit(" "), name("relation"), F.lit(" "), name("object"), F.lit(" ;"))
    lines = facts.select((F.col("row_id") * 2).alias("row_id"), first.alias("line")).union(facts.where("row_id % 3 = 0").select(F.col("row_id") * 2 + 1, F.concat(F.lit('  yago:hasTime "'), F.date_format("ts", "yyyy-MM-dd"), F.lit('" .'))))
    return sources.parse_turtle(lines).drop("day")


@query("SELECT line, min(doc_id * 1000000 + i) AS first_at FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents) GROUP BY line", facts=False)
def dedup_lines(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line")).select((F.col("doc_id") * 1_000_000 + F.col("i")).alias("row_id"), "line")
    return sources.distinct_lines(lines).select("line", F.col("row_id").alias("first_at"))


@query("SELECT row_id, subject || ' ' || lower(replace(relation, '_', ' ')) || ' ' || object || ' on ' || ts AS sentence FROM facts")
def fact_sentence(facts):
    return facts.select("row_id", names.sentence("subject", "relation", "object", "ts").alias("sentence"))


@query("""SELECT row_id, s AS p, o FROM (SELECT row_id, unnest(['type', 'subject', 'relation', 'object', 'timestamp']) AS s, unnest(['Event', subject, relation, object, ts::VARCHAR]) AS o FROM facts)""")
def event_triples(facts):
    return sources.triples(facts).select(F.regexp_extract("s", r"(\d+)", 1).cast("long").alias("row_id"), "p", "o")


@query("SELECT row_id, subject || ' ' || object AS plain, subject || '_' || object || '_s' AS quoted FROM facts")
def iri_names(facts):
    """Names with spaces and quotes as IRIs, and back without the prefix."""
    named = facts.select("row_id", F.concat("subject", F.lit(" "), "object").alias("name"), F.concat("subject", F.lit(" "), "object", F.lit("'s")).alias("odd"))
    full = F.concat(F.lit("http://x/"), sources.iri("name"))
    return named.select("row_id", F.translate(sources.local_name(full, "http://x/"), "_", " ").alias("plain"), sources.iri("odd", "underscore").alias("quoted"))


@query("""SELECT a.row_id AS row1, b.row_id AS row2, 'Path_0: (' || a.subject || ', signup, ' || a.object || ', t=' || a.ts || ') → (' || b.subject || ', purchase, ' || b.object || ', t=' || b.ts || ')' AS text, a.day AS first, b.day AS last, b.day - a.day AS span,
array_to_string(list_sort(list_distinct([a.subject, a.object, b.subject, b.object])), ',') AS entities FROM facts a JOIN facts b ON a.object = b.subject AND a.day <= b.day WHERE a.relation = 'signup' AND b.relation = 'purchase'""")
def path_descriptions(facts):
    p = patterns.object_chain(facts, ("signup", "purchase")).withColumn("range", names.path_range(F.col("path")))
    text = names.path_text(F.lit(0), F.col("path")).alias("text")
    return p.select(F.expr("path[0].row_id").alias("row1"), F.expr("path[1].row_id").alias("row2"), text, "range.first", "range.last", "range.span", F.array_join(names.path_entities(F.col("path")), ",").alias("entities"))


@query("SELECT relation, '{\"head\":\"' || relation || '\",\"body\":[\"click\",\"view\"],\"signature\":\"' || relation || '<-click_view\",\"support\":' || count(*) || '}' AS json, relation || '(X0,X2) <- click(X0,X1) ^ view(X1,X2)' AS text FROM facts GROUP BY relation")
def rule_texts(facts):
    by = facts.groupBy("relation").agg(F.count("*").alias("n"))
    body = F.array(*map(F.lit, BODY))
    return by.select("relation", names.rule_json(F.col("relation"), body, support=F.col("n")).alias("json"), names.rule_text(F.col("relation"), body).alias("text"))


@query("""SELECT event_id, stamp, CASE WHEN stamp > m THEN m ELSE stamp END AS clamped FROM (SELECT event_id, s AS stamp, strftime(last_day(CAST(substr(s, 1, 8) || '01' AS DATE)), '%Y-%m-%d') AS m FROM (SELECT event_id, '20' || lpad(CAST(event_id % 40 AS VARCHAR), 2, '0') || '-' || lpad(CAST(event_id % 12 + 1 AS VARCHAR), 2, '0') || '-' || lpad(CAST(event_id % 31 + 1 AS VARCHAR), 2, '0') AS s FROM events))""", facts=False)
def date_clamp(spark, sf_dir):
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    e = F.col("event_id")
    stamp = F.concat(F.lit("20"), two(e % 40), F.lit("-"), two(e % 12 + 1), F.lit("-"), two(e % 31 + 1))
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", stamp.alias("stamp")).withColumn("clamped", temporal.clamp_date(F.col("stamp")))


# --- rules -----------------------------------------------------------------------------------------------------------


def relation_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors 0.. of the embeddings table for the relations in sorted order."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", F.col("embedding").alias("vector"))
    return lookup.vocabulary(sources.from_events(spark, sf_dir), "relation").join(e, F.col("id") == F.col("vec_id")).select(F.col("value").alias("relation"), "vector")


VECTORS_SQL = "rv AS (SELECT r.relation, e.embedding::DOUBLE[] AS v FROM (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS id FROM (SELECT DISTINCT relation FROM facts)) r JOIN embeddings e ON e.vec_id = r.id)"
GAP_SQL = "dn AS (SELECT relation, day, count(*) AS n FROM facts GROUP BY ALL), gaps AS (SELECT a.relation AS relation_a, b.relation AS relation_b, sum(a.n * b.n * abs(a.day - b.day)) / sum(a.n * b.n) AS gap FROM dn a JOIN dn b ON a.relation <= b.relation GROUP BY ALL)"


@query(f"WITH {VECTORS_SQL} SELECT a.relation AS relation_a, b.relation AS relation_b, round(list_cosine_similarity(a.v, b.v), 6) AS similarity FROM rv a JOIN rv b ON a.relation < b.relation", facts=False)
def relation_cosine(spark, sf_dir):
    v = relation_vectors(spark, sf_dir)
    a, b = (v.select(F.col("relation").alias(f"relation_{x}"), F.col("vector").alias(f"v_{x}")) for x in "ab")
    return a.join(b, F.col("relation_a") < F.col("relation_b")).select("relation_a", "relation_b", F.round(names.cosine(F.col("v_a"), F.col("v_b")), 6).alias("similarity"))


@query(f"WITH {GAP_SQL} SELECT relation_a, relation_b, round(gap, 6) AS gap FROM gaps")
def mean_interval(facts):
    return rounded(rules.mean_pairwise_gap(facts), "gap")


@query(f"""WITH {VECTORS_SQL}, {GAP_SQL}, s AS (SELECT g.relation_a, g.relation_b, list_cosine_similarity(a.v, b.v) AS semantic, (SELECT count(*) FROM facts WHERE relation = g.relation_b) / (SELECT count(*) FROM facts) AS frequency, CASE WHEN gap > 0 THEN 1 / gap ELSE 0.01 END AS temporal FROM gaps g JOIN rv a ON a.relation = g.relation_a JOIN rv b ON b.relation = g.relation_b)
SELECT relation_a, relation_b, round(semantic, 6) AS semantic, round(frequency, 6) AS frequency, round(temporal, 6) AS temporal, round(0.5 * semantic + 0.3 * frequency + 0.2 * least(temporal, 0.5) * 2, 6) AS score FROM s""", facts=False)
def composite_score(spark, sf_dir):
    return rounded(rules.composite_scores(sources.from_events(spark, sf_dir), relation_vectors(spark, sf_dir)), "semantic", "frequency", "temporal", "score")


def confidence_sql(body: tuple[str, ...], head: str, validity: float, facts: str = "facts") -> str:
    n = len(body)
    both = " AND ".join([f"relation = '{body[0]}'"] + [f"lead(relation, {k}) OVER w = '{r}'" for k, r in enumerate(body) if k])
    chain = f"(SELECT min(p.pos) FROM pf p WHERE p.subject = f.subject AND p.object = f.object AND p.pos >= f.pos AND p.relation = '{body[0]}')"
    steps = [f"q0 AS (SELECT f.*, {chain} AS p0 FROM pf f)"]
    for k in range(1, n):
        steps.append(f"q{k} AS (SELECT f.*, (SELECT min(p.pos) FROM pf p WHERE p.subject = f.subject AND p.object = f.object AND p.pos > f.p{k - 1} AND p.relation = '{body[k]}') AS p{k} FROM q{k - 1} f)")
    return f"""pf AS (SELECT *, row_number() OVER w AS pos, coalesce({both} AND lead(day, {n}) OVER w - day <= {validity}, false) AS strict, coalesce(lead(relation, {n}) OVER w = '{head}', false) AS shead FROM {facts} WINDOW w AS (PARTITION BY subject, object ORDER BY day, row_id)),
{', '.join(steps)}, m AS (SELECT q.*, coalesce(z.day - a.day <= {validity}, false) AS relaxed, EXISTS (SELECT 1 FROM pf h WHERE h.subject = q.subject AND h.object = q.object AND h.pos >= q.pos AND h.relation = '{head}') AS later
FROM q{n - 1} q LEFT JOIN pf a ON a.subject = q.subject AND a.object = q.object AND a.pos = q.p0 LEFT JOIN pf z ON z.subject = q.subject AND z.object = q.object AND z.pos = q.p{n - 1}),
v AS (SELECT subject, object, pos, strict OR relaxed AS matched, CASE WHEN strict THEN shead ELSE relaxed AND later END AS hit FROM m),
s AS (SELECT *, coalesce(sum(hit::INT) OVER (PARTITION BY subject, object ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM v)
SELECT CAST(sum(matched::INT) AS BIGINT) AS b, CAST(sum(hit::INT) AS BIGINT) AS hb FROM s WHERE done = 0"""


@query("WITH " + confidence_sql(("click",), "purchase", 10))
def rule_confidence_len1(facts):
    return rules.confidence(facts, ("click",), "purchase", 10)


@query("WITH " + confidence_sql(("click", "view"), "purchase", 20))
def rule_confidence_len2(facts):
    return rules.confidence(facts, ("click", "view"), "purchase", 20)


@query("""WITH by_r AS (SELECT relation, count(*) / (SELECT count(*) FROM facts) AS freq, min(day) AS lo, max(day) AS hi FROM facts GROUP BY relation), h AS (SELECT * FROM by_r WHERE relation = 'purchase')
SELECT round(0.3 + 0.4 * least(1.0, avg(50 * b.freq + 0.5 * greatest(0, least(b.hi, h.hi) - greatest(b.lo, h.lo)) / greatest(1, greatest(b.hi, h.hi) - least(b.lo, h.lo)))), 6) AS cp FROM by_r b, h WHERE b.relation IN ('click', 'view')""")
def rule_heuristic_confidence(facts):
    return rounded(rules.heuristic_confidence(facts, BODY, HEAD), "cp")


@query("""WITH p AS (SELECT relation, lead(relation) OVER w AS r1, day, lead(day) OVER w AS d1, row_number() OVER w - 1 AS pos, count(*) OVER () AS n FROM facts WINDOW w AS (ORDER BY day, row_id))
SELECT CAST(sum((d1 - day <= 0)::INT) AS BIGINT) AS b_valid, count(*) AS b_total, round(sum((d1 - day <= 0)::INT) / count(*), 6) AS coverage FROM p WHERE relation = 'click' AND r1 = 'view' AND pos < n - 2""")
def rule_coverage(facts):
    return rounded(rules.coverage(facts, BODY, 0), "coverage")


def coverage_sql(body: tuple[str, ...], validity: float, facts: str = "facts") -> str:
    n = len(body)
    led = "".join(f", lead(relation, {k}) OVER w AS r{k}" for k in range(1, n))
    same = " AND ".join([f"relation = '{body[0]}'"] + [f"r{k} = '{r}'" for k, r in enumerate(body) if k])
    return f"""SELECT CAST(coalesce(sum((last_day - day <= {validity})::INT), 0) AS BIGINT) AS b_valid, count(*) AS b_total FROM (SELECT relation, day, lead(day, {n - 1}) OVER w AS last_day{led},
  row_number() OVER w - 1 AS pos, count(*) OVER () AS n FROM {facts} WINDOW w AS (ORDER BY day, row_id)) WHERE {same} AND pos < n - {n}"""


def evaluation_sql(facts: str = "facts") -> str:
    """CTEs up to ev: the rules of RULES with confidence, coverage and priority on the relation `facts`."""
    stats = f"st AS (SELECT relation, count(*) / (SELECT count(*) FROM {facts}) AS freq, min(day) AS lo, max(day) AS hi FROM {facts} GROUP BY relation)"
    each = []
    for rule, body, head, validity in RULES:
        values = ", ".join(f"('{r}')" for r in body)
        else_ = f"""(SELECT 0.3 + 0.4 * least(1.0, avg(50 * coalesce(b.freq, 0) + 0.5 * CASE WHEN h.lo IS NULL THEN 0.1 ELSE coalesce(greatest(0, least(b.hi, h.hi) - greatest(b.lo, h.lo)) / greatest(1, greatest(b.hi, h.hi) - least(b.lo, h.lo)), 0) END))
  FROM (VALUES {values}) v(r) LEFT JOIN st b ON b.relation = r LEFT JOIN st h ON h.relation = '{head}')"""
        each.append(f"""SELECT {rule} AS rule_id, '{head}' AS head, '{",".join(body)}' AS body, {validity}::DOUBLE AS validity, b, hb, CASE WHEN b > 0 THEN hb / b ELSE {else_} END AS cp, b_valid, b_total,
  CASE WHEN b_total > 0 THEN b_valid / b_total ELSE 0.0 END AS coverage FROM (WITH {confidence_sql(body, head, validity, facts)}), ({coverage_sql(body, validity, facts)})""")
    return f"{stats}, e0 AS ({' UNION ALL '.join(each)}), ev AS (SELECT *, 0.7 * cp + 0.3 * coverage AS priority FROM e0)"


def _rule_columns(df: DataFrame, *more: str) -> DataFrame:
    return rounded(df.withColumn("body", F.array_join("body", ",")), "cp", "coverage", "priority", *more)


RULE_SQL = "rule_id, head, body, validity, b, hb, round(cp, 6) AS cp, b_valid, b_total, round(coverage, 6) AS coverage, round(priority, 6) AS priority"


@query(f"WITH {evaluation_sql()} SELECT {RULE_SQL} FROM ev")
def rule_evaluation(facts):
    return _rule_columns(rules.evaluate(facts, list(RULES)))


@query(f"WITH {evaluation_sql()} SELECT {RULE_SQL}, row_number() OVER (ORDER BY ev.priority DESC, rule_id) AS rank FROM ev WHERE ev.priority >= 0.3")
def rule_ranking(facts):
    return _rule_columns(rules.ranked(rules.evaluate(facts, list(RULES)), 0.3))


@query(f"WITH {evaluation_sql()} SELECT {RULE_SQL} FROM ev")
def rule_evaluation_by_steps(facts):
    """Facts arrive in three steps; counts are advanced, not taken anew."""
    state = incremental.State(facts.sparkSession, shared_path(facts.sparkSession, "evolution"), RULES)
    for low, high in ((None, 19732), (19732, 19741), (19741, None)):
        part = facts if low is None else facts.where(F.col("day") >= low)
        state = incremental.advance(state, part if high is None else part.where(F.col("day") < high))
    return _rule_columns(incremental.evaluate(state))


CURRENT_SQL = f"cur AS (SELECT * FROM facts WHERE day >= {QUERY_DAY}), {evaluation_sql('cur')}"


@query(f"""WITH {CURRENT_SQL}, sp AS (SELECT coalesce(max(day) - min(day), 0) AS span FROM cur)
SELECT {RULE_SQL.replace("validity,", "round(greatest((validity + span) / 2, 36.0), 6) AS validity,")}, NOT (ev.priority < 0.6 AND ev.cp < 0.6) AS retained FROM ev, sp""")
def rule_evolution(facts):
    return _rule_columns(rules.evolve(facts, facts.where(F.col("day") >= QUERY_DAY), list(RULES)), "validity")


@query(f"WITH {CURRENT_SQL}, k AS (SELECT NOT (priority < 0.6 AND cp < 0.6) AS retained FROM ev) SELECT 1 AS step, count(*) AS total_rules, count(*) FILTER (retained) AS retained, count(*) FILTER (NOT retained) AS eliminated, round(count(*) FILTER (NOT retained) / greatest(1, count(*)), 6) AS elimination_rate FROM k")
def evolution_history(facts):
    judged = rules.eliminated(rules.evaluate(facts.where(F.col("day") >= QUERY_DAY), list(RULES)))
    return rounded(rules.history_step(judged, 1), "elimination_rate")


@query(f"WITH {evaluation_sql()} SELECT count(*) AS rules, round(min(cp), 6) AS min_cp, round(max(cp), 6) AS max_cp, round(min(priority), 6) AS min_priority, round(max(priority), 6) AS max_priority FROM ev")
def rule_statistics(facts):
    return rounded(rules.statistics(rules.evaluate(facts, list(RULES))), "min_cp", "max_cp", "min_priority", "max_priority")


@query("""WITH e AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM (SELECT subject AS value FROM facts UNION SELECT object FROM facts)), r AS (SELECT relation, row_number() OVER (ORDER BY relation) - 1 AS id FROM (SELECT DISTINCT relation FROM facts))
SELECT row_id, s.id AS subject_id, r.id AS relation_id, o.id AS object_id, day FROM facts JOIN e s ON s.value = subject JOIN r USING (relation) JOIN e o ON o.value = object""")
def encoded_facts(facts):
    return lookup.encoded(facts)


@query("SELECT (SELECT count(*) FROM (SELECT subject FROM facts UNION SELECT object FROM facts)) AS nodes, count(*) AS edges FROM facts")
def graph_size(facts):
    return lookup.graph_size(facts)


@query("SELECT relation, coalesce(max(19780 - day), 30)::DOUBLE AS validity FROM facts WHERE relation IN ('error', 'view') GROUP BY relation")
def longest_gap_validity(facts):
    gaps = facts.where(F.col("relation").isin("error", "view")).select("relation", (19780 - F.col("day")).alias("gap"))
    return rules.longest_gap(gaps, ["relation"])


@query("SELECT row_id, subject, relation, object, day FROM facts WHERE day <= 19735")
def facts_of_the_past(facts):
    return lookup.history(facts, 19735).select("row_id", "subject", "relation", "object", "day")


@query("SELECT row_id, subject, relation, object, day FROM facts ORDER BY row_id LIMIT 100")
def facts_without_a_past(facts):
    return lookup.history(facts, -1).select("row_id", "subject", "relation", "object", "day")


@query("SELECT l_orderkey, l_linenumber, NOT (0.7 * l_discount * 10 + 0.3 * l_tax * 10 < 0.6 AND l_discount * 10 < 0.6) AS retained FROM lineitem", facts=False)
def rule_eviction(spark, sf_dir):
    r = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", (F.col("l_discount") * 10).alias("cp"), (0.7 * F.col("l_discount") * 10 + 0.3 * F.col("l_tax") * 10).alias("priority"))
    return rules.eliminated(r).select("l_orderkey", "l_linenumber", "retained")


@query("""WITH p AS (SELECT a.relation, b.day - a.day AS span, 19780 - b.day AS gap FROM facts a JOIN facts b ON a.object = b.subject AND a.day <= b.day AND b.relation = 'signup' WHERE a.relation IN ('error', 'view'))
SELECT relation, round(least(greatest(greatest(1.2 * max(gap), avg(span) * (1 + 0.5 * least(1.0, count(*) / 10))), 15.0), 90.0), 6) AS validity FROM p GROUP BY relation""")
def validity_period(facts):
    a = facts.where(F.col("relation").isin("error", "view")).select("relation", "object", F.col("day").alias("d1"))
    b = facts.where(F.col("relation") == "signup").select(F.col("subject").alias("object"), F.col("day").alias("d2"))
    p = a.join(b, "object").where("d1 <= d2").select("relation", (F.col("d2") - F.col("d1")).alias("span"), (19780 - F.col("d2")).alias("gap"))
    return rounded(rules.validity_period(p), "validity")


@query("SELECT row_id, round(exp(-0.1 * abs(19742 - day)), 6) AS decay FROM facts")
def time_decay_score(facts):
    return facts.select("row_id", F.round(temporal.decay(F.col("day"), F.lit(QUERY_DAY)), 6).alias("decay"))


@query("SELECT row_id FROM facts WHERE relation = 'view' ORDER BY md5('42:' || row_id), row_id LIMIT 50")
def sampled_heads(facts):
    return paths.sample(facts.where(F.col("relation") == "view"), 50).select("row_id")


@query(facts=False)
def path_rules(spark, sf_dir):
    """Sampled paths of all relations, judged by quality, as rules."""
    f, v = sources.from_events(spark, sf_dir), relation_vectors(spark, sf_dir)
    targets = f.groupBy(F.col("relation").alias("target")).agg(F.max("day").alias("target_day"))
    found = paths.validated(paths.sample_paths(f, rules.composite_scores(f, v), targets), v)
    return rules.rules_of_paths(found).select("rule_id", "head", names.rule_signature(F.col("head"), F.col("body")).alias("signature"), F.size("body").alias("length"))


@query("SELECT a.row_id AS row1, b.row_id AS row2, (19742 - a.day <= 15 AND 19742 - b.day <= 15) AS in_validity FROM facts a JOIN facts b ON a.object = b.subject AND a.day <= b.day WHERE a.relation = 'signup' AND b.relation = 'purchase'")
def path_filter(facts):
    p = patterns.object_chain(facts, ("signup", "purchase"))
    return p.select(F.expr("path[0].row_id").alias("row1"), F.expr("path[1].row_id").alias("row2"), rules.path_in_validity(F.col("path"), F.lit(QUERY_DAY), F.lit(15)).alias("in_validity"))


# --- reasoning -------------------------------------------------------------------------------------------------------

TEST_SQL = "tests AS (SELECT row_id AS query_id, subject, relation, object, day FROM (SELECT *, row_number() OVER (ORDER BY day, row_id) - 1 AS pos, count(*) OVER () AS n FROM facts) WHERE pos >= floor(n * (0.8::DOUBLE + 0.1::DOUBLE)))"
HOP_SQL = """st AS (SELECT t.query_id, t.day AS q_day, t.subject AS q_subject, f.row_id AS start_row, f.object AS o1, f.day AS d1 FROM tests t JOIN facts f ON f.subject = t.subject AND f.relation = 'click' AND f.day <= t.day),
ask AS (SELECT DISTINCT o1, d1 FROM st), nx AS (SELECT a.o1, a.d1, min(struct_pack(d := f.day, r := f.row_id, o := f.object)) AS x FROM ask a JOIN facts f ON f.subject = a.o1 AND f.relation = 'view' AND f.day > a.d1 GROUP BY ALL),
ch AS (SELECT st.query_id, st.q_subject, st.q_day, st.start_row, nx.x.o AS object, st.d1, nx.x.d AS d2 FROM st JOIN nx USING (o1, d1) WHERE nx.x.d <= st.q_day)"""


def tests(facts: DataFrame) -> DataFrame:
    """All facts of the test split as questions, written, as a query uses them in several places."""
    return durable(lookup.test_facts(facts).select(F.col("row_id").alias("query_id"), "subject", "relation", "object", "day"), "questions")


def fixed_rules(facts: DataFrame) -> DataFrame:
    path = "array<struct<subject:string,object:string>>"
    rows = [(1, ["click", "view"], 0.8, 0.75, [("u1", "u2"), ("u2", "u3")]), (2, ["signup"], 0.4, 0.55, [("u4", "u5")]), (3, ["error", "view", "click"], 0.9, 0.4, [("u6", "u7")])]
    return facts.sparkSession.createDataFrame(rows, f"rule_id long, body array<string>, cp double, priority double, source_path {path}")


@query(f"WITH {TEST_SQL}, {HOP_SQL} SELECT query_id, start_row, object, d1, d2 FROM ch")
def asof_chain(facts):
    found = reasoning.chains(facts, tests(facts), fixed_rules(facts).where("rule_id = 1"), 2)
    return found.select("query_id", "start_row", "object", F.get("days", F.lit(0)).alias("d1"), F.get("days", F.lit(1)).alias("d2"))


SCORE_SQL = f"""{TEST_SQL}, {HOP_SQL}, parts AS (SELECT query_id, q_subject, object AS entity, 1.6 + exp(-0.1 * (q_day - d1)) + exp(-0.1 * (q_day - d2)) AS score FROM ch
UNION ALL SELECT t.query_id, t.subject, f.object, 0.4 + exp(-0.1 * (t.day - f.day)) FROM tests t JOIN facts f ON f.subject = t.subject AND f.relation = 'signup' AND f.day <= t.day),
rs AS (SELECT query_id, entity, sum(score) AS score FROM parts WHERE entity <> q_subject GROUP BY ALL)"""


@query(f"WITH {SCORE_SQL} SELECT query_id, entity, round(score, 6) AS score FROM rs")
def rule_candidate_scores(facts):
    return rounded(reasoning.rule_scores(facts, tests(facts), fixed_rules(facts)), "score")


ALPHA_SQL = """days AS (SELECT DISTINCT day AS q FROM tests), nr AS (SELECT q, q - day AS gap, row_number() OVER (PARTITION BY q ORDER BY row_id DESC) AS k FROM days JOIN facts ON day <= q),
dist AS (SELECT q, avg(gap) FILTER (k <= 100) AS dr, avg(gap) FILTER (k <= 50) AS dg FROM nr GROUP BY q),
al AS (SELECT t.query_id, dr, dg, 0.5 * exp(-0.1 * dr) / (0.5 * exp(-0.1 * dr) + 0.5 * exp(-0.1 * dg)) AS alpha FROM tests t JOIN dist ON q = t.day)"""


@query(f"WITH {TEST_SQL}, {ALPHA_SQL} SELECT query_id, round(dr, 6) AS dr, round(dg, 6) AS dg, round(alpha, 6) AS alpha FROM al")
def dynamic_alpha(facts):
    return rounded(weights(facts, tests(facts)), "dr", "dg", "alpha")


def weights(facts: DataFrame, t: DataFrame) -> DataFrame:
    return reasoning.mean_distances(facts, t).withColumn("alpha", reasoning.alpha(F.col("dr"), F.col("dg")))


def frequency_side(facts: DataFrame, t: DataFrame) -> DataFrame:
    """Objects of a question's subject before its day by their share: a plain graph side, from running counts."""
    wanted = facts.where("object <> subject").join(t.select("subject").distinct(), "subject", "left_semi")
    counts = durable(wanted.groupBy("subject", F.col("object").alias("entity"), "day").agg(F.count("*").alias("c")), "object-counts")
    by = reasoning.sums_as_of(counts, t, ["c"], strict=True)
    by = by.withColumn("score", F.col("c") / F.sum("c").over(Window.partitionBy("subject", "day")))
    return t.select("query_id", "subject", "day").join(by, ["subject", "day"]).select("query_id", "entity", "score")


FREQ_SQL = "fc AS (SELECT t.query_id, f.object AS entity, count(*) AS c FROM tests t JOIN facts f ON f.subject = t.subject AND f.day < t.day AND f.object <> t.subject GROUP BY ALL), gs AS (SELECT query_id, entity, c / sum(c) OVER (PARTITION BY query_id) AS score FROM fc)"
FUSE_SQL = f"""{SCORE_SQL}, {ALPHA_SQL}, {FREQ_SQL}, r1 AS (SELECT query_id, entity, score / greatest(1.0, max(score) OVER (PARTITION BY query_id)) AS r FROM rs), g1 AS (SELECT query_id, entity, score / greatest(1.0, max(score) OVER (PARTITION BY query_id)) AS g FROM gs),
fu AS (SELECT query_id, entity, round(alpha * coalesce(r, 0) + (1 - alpha) * coalesce(g, 0), 9) AS score FROM r1 FULL JOIN g1 USING (query_id, entity) JOIN al USING (query_id)),
rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS rank FROM fu)"""


def fused(facts: DataFrame, t: DataFrame) -> DataFrame:
    both = reasoning.fuse(reasoning.rule_scores(facts, t, fixed_rules(facts)), frequency_side(facts, t), weights(facts, t)).withColumn("score", F.round("score", 9))
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "entity")).cast("long"))


@query(f"WITH {FUSE_SQL} SELECT query_id, entity, round(score, 6) AS score, rank FROM rk WHERE rank <= 10")
def fused_ranking(facts):
    return rounded(fused(facts, tests(facts)).where("rank <= 10"), "score")


@query(f"""WITH {FUSE_SQL}, sz AS (SELECT query_id, count(*) AS size FROM rk GROUP BY query_id), pl AS (SELECT t.query_id, coalesce(size, 0) AS size, coalesce(rank, coalesce(size, 0) + 1) AS rank FROM tests t LEFT JOIN rk ON rk.query_id = t.query_id AND rk.entity = t.object LEFT JOIN sz ON sz.query_id = t.query_id)
SELECT count(*) AS queries, round(avg(CASE WHEN size > 0 THEN 1 / rank ELSE 0 END), 6) AS mrr, round(avg(CASE WHEN size > 0 THEN (rank <= 1)::INT ELSE 0 END), 6) AS hit1, round(avg(CASE WHEN size > 0 THEN (rank <= 3)::INT ELSE 0 END), 6) AS hit3, round(avg(CASE WHEN size > 0 THEN (rank <= 10)::INT ELSE 0 END), 6) AS hit10 FROM pl""")
def mrr_hits(facts):
    t = tests(facts)
    return reasoning.metrics(fused(facts, t), t.select("query_id", "object"))


@query(f"WITH {TEST_SQL} SELECT t.query_id, f.row_id FROM tests t JOIN facts f ON f.subject = t.subject AND f.day BETWEEN t.day - 5 AND t.day")
def context_window(facts):
    return lookup.context_window(facts, tests(facts), 5).select("query_id", "row_id")


@query(f"""WITH {TEST_SQL}, e AS (SELECT query_id, unnest(['click', 'view', 'signup']) AS relation FROM tests WHERE relation = 'purchase'), s AS (SELECT DISTINCT t.query_id, f.relation FROM tests t JOIN facts f ON f.subject = t.subject AND f.day BETWEEN t.day - 2 AND t.day)
SELECT query_id, relation, row_number() OVER (PARTITION BY query_id ORDER BY relation) AS rank FROM e WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.query_id = e.query_id AND s.relation = e.relation)""")
def missing_relations(facts):
    r = facts.sparkSession.createDataFrame([("purchase", ["click", "view"]), ("purchase", ["signup"])], "head string, body array<string>")
    return lookup.missing_relations(facts, tests(facts), r, 2)


@query("""WITH n AS (SELECT DISTINCT c_mktsegment AS a FROM customer), p AS (SELECT x.a, y.a AS b FROM n x JOIN n y ON x.a <= y.a), k AS (SELECT a, b, CASE WHEN a[1:5] = b[1:5] AND len(a) >= 5 AND len(b) >= 5 THEN 5 WHEN a[1:4] = b[1:4] THEN 4 WHEN a[1:3] = b[1:3] THEN 3 WHEN a[1:2] = b[1:2] THEN 2 ELSE 0 END AS pre, len(list_intersect(string_split(a, ' '), string_split(b, ' '))) AS w FROM p)
SELECT a, b, round(CASE WHEN a = b THEN 1.0 ELSE least(1.0, greatest(0.1, (CASE WHEN pre >= 4 THEN 0.5 + 0.1 * pre WHEN pre >= 2 THEN 0.3 + 0.1 * pre ELSE 0.2 END + CASE WHEN w > 0 THEN 0.3 + 0.2 * least(w, 3) ELSE 0.2 END) / 2)) END, 6) AS similarity FROM k""", facts=False)
def entity_similarity(spark, sf_dir):
    n = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_mktsegment").alias("a")).distinct()
    return n.join(n.select(F.col("a").alias("b")), F.col("a") <= F.col("b")).select("a", "b", F.round(names.name_similarity(F.col("a"), F.col("b")), 6).alias("similarity"))


@query("SELECT row_id AS query_id, object AS entity, CAST(CASE object WHEN 'u5' THEN 2 WHEN 'u7' THEN 3 ELSE 1 END AS BIGINT) AS rule_id, CASE object WHEN 'u5' THEN 0.55 WHEN 'u7' THEN 0.4 ELSE 0.75 END AS priority FROM facts WHERE object IN ('u2', 'u3', 'u5', 'u7')")
def best_rule_for_entity(facts):
    return reasoning.best_rules(facts.select(F.col("row_id").alias("query_id"), F.col("object").alias("entity")), fixed_rules(facts))


@query(f"""WITH {TEST_SQL}, {FREQ_SQL}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity) AS k FROM gs) SELECT query_id, entity, round(CASE WHEN k <= 3 THEN score * 0.7 ELSE score END, 6) AS score FROM rk""")
def verify_topn_passthrough(facts):
    side = frequency_side(facts, tests(facts))
    return rounded(reasoning.verify_first(side, side.withColumn("score", F.col("score") * 0.7), 3), "score")


VIRTUAL_SQL = """ca AS (SELECT g.query_id, g.entity, g.score, t.subject AS qs, t.day AS qd FROM gs g JOIN tests t USING (query_id)),
di AS (SELECT query_id, entity, list(relation ORDER BY row_id) AS rels FROM (SELECT c.query_id, c.entity, f.relation, f.row_id, row_number() OVER (PARTITION BY c.query_id, c.entity ORDER BY f.row_id) AS k FROM ca c JOIN facts f ON f.subject = c.qs AND f.object = c.entity AND f.day <= c.qd) WHERE k <= 3 GROUP BY ALL),
ou AS (SELECT qs, qd, arg_min(f.relation, f.row_id) AS r FROM (SELECT DISTINCT qs, qd FROM ca) JOIN facts f ON f.subject = qs AND f.day <= qd GROUP BY ALL),
i_ AS (SELECT entity, qd, arg_min(f.relation, f.row_id) AS r FROM (SELECT DISTINCT entity, qd FROM ca) JOIN facts f ON f.object = entity AND f.day <= qd GROUP BY ALL),
vp AS (SELECT ca.*, coalesce(di.rels, list_distinct([ou.r, i_.r])) AS rels FROM ca LEFT JOIN di USING (query_id, entity) LEFT JOIN ou USING (qs, qd) LEFT JOIN i_ USING (entity, qd)),
dg AS (SELECT query_id, entity, score, rels, greatest(100.0 * len(list_intersect(['click', 'view'], rels)) / 2, 100.0 * len(list_intersect(['signup'], rels)), 100.0 * len(list_intersect(['error', 'view', 'click'], rels)) / 3) AS degree FROM vp)"""


@query(f"WITH {TEST_SQL}, {FREQ_SQL}, {VIRTUAL_SQL} SELECT query_id, entity, round(score * CASE WHEN len(rels) = 0 THEN 1.0 WHEN degree > 0 THEN degree / 100 ELSE 0.7 END, 6) AS score FROM dg")
def verified_graph_side(facts):
    t = tests(facts)
    side = durable(frequency_side(facts, t), "side")
    paths_ = reasoning.virtual_paths(facts, side.select("query_id", "entity"), t)
    return rounded(reasoning.verify_graph(side, paths_, fixed_rules(facts)), "score")


def similarity_sql(a: str, b: str) -> str:
    """names.name_similarity() of names without spaces."""
    prefix = f"CASE WHEN len({a}) >= 5 AND len({b}) >= 5 AND {a}[1:5] = {b}[1:5] THEN 5 WHEN len({a}) >= 4 AND len({b}) >= 4 AND {a}[1:4] = {b}[1:4] THEN 4 WHEN len({a}) >= 3 AND len({b}) >= 3 AND {a}[1:3] = {b}[1:3] THEN 3 WHEN len({a}) >= 2 AND len({b}) >= 2 AND {a}[1:2] = {b}[1:2] THEN 2 ELSE 0 END"
    return f"CASE WHEN {a} = {b} THEN 1.0 ELSE least(1.0, greatest(0.1, (CASE {prefix} WHEN 5 THEN 1.0 WHEN 4 THEN 0.9 WHEN 3 THEN 0.6 WHEN 2 THEN 0.5 ELSE 0.2 END + 0.2) / 2)) END"


@query(f"""WITH {SCORE_SQL}, pa(rule_id, s, o) AS (VALUES (1, 'u1', 'u2'), (1, 'u2', 'u3'), (2, 'u4', 'u5'), (3, 'u6', 'u7')), br AS (SELECT rs.*, t.subject AS qs, CASE entity WHEN 'u2' THEN 1 WHEN 'u3' THEN 1 WHEN 'u5' THEN 2 WHEN 'u7' THEN 3 END AS rule_id FROM rs JOIN tests t USING (query_id)),
me AS (SELECT query_id, entity, avg(x) AS mean FROM (SELECT query_id, entity, {similarity_sql("qs", "s")} AS x FROM br JOIN pa USING (rule_id) UNION ALL SELECT query_id, entity, {similarity_sql("entity", "o")} FROM br JOIN pa USING (rule_id)) GROUP BY ALL)
SELECT query_id, entity, round(score * coalesce(mean, 0.8), 6) AS score FROM br LEFT JOIN me USING (query_id, entity)""")
def verified_rule_side(facts):
    r, t = fixed_rules(facts), tests(facts)
    side = reasoning.rule_scores(facts, t, r)
    return rounded(reasoning.verify_rules(side, t, reasoning.best_rules(side, r), r), "score")


def vector_sql(name: str, names_of: str) -> str:
    """CTE `name` (name, i, x): the unit vector that md5 gives to each name of the relation `names_of`."""
    return f"""{name}_ AS (SELECT name, i, ('0x' || substr(md5(name || ':' || i), 1, 6))::BIGINT / 8388608.0::DOUBLE - 1 AS x FROM {names_of}, (SELECT unnest(range(1, {embed.DIMENSIONS + 1})) AS i)),
{name} AS (SELECT name, i, x / sqrt(sum(x * x) OVER (PARTITION BY name)) AS x FROM {name}_)"""


def layer_sql(before: str, after: str) -> str:
    return f"""{after}_m AS (SELECT object AS name, v.i, sum(n * (v.x + r.x)) AS x FROM edges_by JOIN {before} v ON v.name = subject JOIN rv0 r ON r.name = relation AND r.i = v.i GROUP BY ALL),
{after}_u AS (SELECT name, i, x / sqrt(sum(x * x) OVER (PARTITION BY name)) AS x FROM {after}_m),
{after}_h AS (SELECT v.name, v.i, CASE WHEN u.x IS NULL THEN v.x ELSE 0.5 * v.x + 0.5 * u.x END AS x FROM {before} v LEFT JOIN {after}_u u USING (name, i)),
{after} AS (SELECT name, i, x / sqrt(sum(x * x) OVER (PARTITION BY name)) AS x FROM {after}_h)"""


@query(f"""WITH {TEST_SQL}, nm AS (SELECT subject AS name FROM facts UNION SELECT object FROM facts), rn AS (SELECT DISTINCT relation AS name FROM facts), {vector_sql("v0", "nm")}, {vector_sql("rv0", "rn")},
edges_by AS (SELECT subject, relation, object, count(*) AS n FROM facts GROUP BY ALL), {layer_sql("v0", "v1")}, {layer_sql("v1", "v2")},
qv AS (SELECT q.subject, q.relation, v.i, v.x + r.x AS x FROM (SELECT DISTINCT subject, relation FROM tests) q JOIN v2 v ON v.name = q.subject JOIN rv0 r ON r.name = q.relation AND r.i = v.i),
co AS (SELECT q.subject, q.relation, e.name AS entity, sum(q.x * e.x) / (sqrt(sum(q.x * q.x)) * sqrt(sum(e.x * e.x))) AS score FROM qv q JOIN v2 e ON e.i = q.i AND e.name <> q.subject GROUP BY ALL),
tk AS (SELECT *, row_number() OVER (PARTITION BY subject, relation ORDER BY score DESC, entity) AS k FROM co WHERE score > 0)
SELECT query_id, entity, round(score, 6) AS score FROM tests JOIN tk USING (subject, relation) WHERE k <= 20""")
def graph_candidates(facts):
    vectors = embed.message_layer(facts, embed.message_layer(facts, embed.entity_vectors(facts)))
    return rounded(embed.graph_scores(vectors, tests(facts)), "score")


@query("SELECT query_id, arg_min(answer, struct_pack(n := -votes, a := answer)) AS answer, max(votes) AS votes FROM (SELECT user_id AS query_id, event_type AS answer, count(*) AS votes FROM events GROUP BY ALL) GROUP BY query_id", facts=False)
def majority_vote(spark, sf_dir):
    return reasoning.majority(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("answer")))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, least(1.0, CAST(json_extract_string(props, '$.k') AS DOUBLE)) AS score FROM events", facts=False)
def reply_parsing(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select("event_id", names.reply_scores(F.concat(F.lit("scores: "), "props"))["k"].alias("k"), names.reply_score(F.col("props")).alias("score"))


@query("SELECT day AS query_id, least(1.0, max(n))::DOUBLE AS score FROM (SELECT day, relation, count(*) AS n FROM facts GROUP BY ALL) GROUP BY day")
def model_replies(facts):
    prompts = reasoning.majority(facts.select(F.col("day").alias("query_id"), F.col("relation").alias("answer"))).select("query_id", F.concat(F.lit("score "), "votes").alias("prompt"))
    return replies.ask(prompts, "echo_number").select("query_id", names.reply_score(F.col("reply")).alias("score"))


@query()
def trained_candidates(facts):
    """Answers of a graph model after two rounds of training on the facts before the questions."""
    split = lookup.time_split(facts)
    past = split.where("split <> 'test'").select(*facts.columns)
    model, _ = graphmodel.train(past, graphmodel.start(past), epochs=2)
    return rounded(graphmodel.graph_scores(past, model, tests(facts).drop("object")), "score")


@query()
def forecast_metrics(facts):
    return forecast.forecast(facts)[2]


@query()
def trained_forecast_metrics(facts):
    """The whole way with the trained model as graph side, verified and fused."""
    return forecast.forecast(facts, s=forecast.Settings(train_epochs=2))[2]


@query(f"WITH rn AS (SELECT DISTINCT 'relation:' || relation AS name FROM facts), {vector_sql('pv', 'rn')} SELECT substr(name, 10) AS relation, round(x, 6) AS first, {embed.DIMENSIONS} AS dimensions FROM pv WHERE i = 1")
def pseudo_relation_vectors(facts):
    return groups.pseudo_vectors(facts).select("relation", F.round(F.get("vector", F.lit(0)), 6).alias("first"), F.size("vector").alias("dimensions"))
