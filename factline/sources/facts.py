"""Readers and writers of dated facts. A fact is (row_id, subject, relation, object, ts, day)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from factline.operators.order import with_position

#: Encodings to try, in this order (fixed values).
ENCODINGS = ("utf-8", "utf-8-sig", "gbk", "gb18030", "latin-1", "cp1252")


def from_events(spark: SparkSession, sf_dir: str, mapping: str = "dense") -> DataFrame:
    """Facts of the events table: user, event type, and the user that `props.k` names (dense: of ten)."""
    k = F.get_json_object("props", "$.k").cast("long")
    target = k % 10 if mapping == "dense" else k
    ts = F.col("ts").cast("date")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("row_id"), F.concat(F.lit("u"), "user_id").alias("subject"), F.col("event_type").alias("relation"),
        F.concat(F.lit("u"), target).alias("object"), ts.alias("ts"), F.unix_date(ts).cast("long").alias("day"),
    )


def probe_encoding(spark: SparkSession, path: str) -> str:
    """The first of ENCODINGS that decodes every line of all files at `path`; no encoding has a line feed inside a
    character, so lines are tried in Arrow batches on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        failed = [0] * len(ENCODINGS)
        for batch in batches:
            text = b"\n".join(batch.column(0).to_pylist())
            for i, name in enumerate(ENCODINGS):
                try:
                    text.decode(name)
                except UnicodeDecodeError:
                    failed[i] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(len(ENCODINGS)), pa.int32()), pa.array(failed, pa.int64())], names=["encoding", "failed"])

    lines = spark.read.text(path).select(F.col("value").cast("binary"))  # the bytes as they are
    failed = lines.mapInArrow(run, "encoding int, failed long").groupBy("encoding").agg(F.sum("failed").alias("failed"))
    fine = failed.where("failed = 0").agg(F.min("encoding")).collect()[0][0]
    return ENCODINGS[fine or 0]


def read_lines(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """(row_id, line) in file order. Spark reads no East Asian charsets, so other encodings than UTF-8 are read byte by
    byte as Latin-1 and decoded in Arrow batches; no such encoding has a line feed inside a character."""
    name = encoding or probe_encoding(spark, path)
    if name in ("utf-8", "utf-8-sig"):
        lines = spark.read.text(path).select(F.col("value").alias("line"))
    else:
        decoded = F.pandas_udf(lambda s: s.map(lambda x: None if x is None else x.encode("latin-1").decode(name, "replace")), "string")
        lines = spark.read.csv(path, schema="line string", sep="\x00", quote="", escape="", encoding="iso-8859-1").select(decoded("line").alias("line"))
    return lines.select(F.monotonically_increasing_id().alias("row_id"), F.regexp_replace("line", "^\ufeff", "").alias("line"))


FIELDS = ("subject", "relation", "object", "timestamp")


BLANKS = " \t\r\n\x0b\x0c\u00a0\u3000"


def repair_lines(lines: DataFrame, full_width: bool = True, columns: tuple[str, ...] = FIELDS) -> DataFrame:
    """Facts from (row_id, line) of comma-separated text without quoting.

    More than four fields: the first is the subject, the last the time, the second to last the object, the others
    joined by a comma the relation. Where the time is empty, full-width commas count: a subject of four parts or more
    gives all four fields, else a relation of three parts or more gives relation, object and time. Rows with an empty
    field or a time not of the form YYYY-MM-DD go (so does a header); so do dates that do not exist. `columns`: the
    order of fields in lines of up to four.
    """
    trimmed = lambda c: F.btrim(c, F.lit(BLANKS))
    df = lines.select("row_id", F.transform(F.split(trimmed(F.col("line")), ","), trimmed).alias("f"))
    many = F.size("f") > 4
    field = lambda name, else_: F.when(many, else_).otherwise(F.coalesce(F.get("f", F.lit(columns.index(name))), F.lit("")))
    df = df.select(
        "row_id", field("subject", F.get("f", F.lit(0))).alias("subject"), field("relation", F.array_join(F.slice("f", F.lit(2), F.greatest(F.size("f") - 3, F.lit(0))), ",")).alias("relation"),
        field("object", F.get("f", F.size("f") - 2)).alias("object"), field("timestamp", F.get("f", F.size("f") - 1)).alias("stamp"),
    )
    if full_width:
        for source, names in (("subject", ("subject", "relation", "object", "stamp")), ("relation", ("relation", "object", "stamp"))):
            df = df.withColumn("p", F.transform(F.split(F.translate(source, "，", ","), ","), trimmed))
            fits = (F.col("stamp") == "") & (F.size("p") >= len(names))
            df = df.withColumns({n: F.when(fits, F.get("p", F.lit(i))).otherwise(F.col(n)) for i, n in enumerate(names)}).drop("p")
    df = df.where(F.col("stamp").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("subject") != "") & (F.col("relation") != "") & (F.col("object") != ""))
    df = df.withColumn("ts", F.try_to_date("stamp", "yyyy-MM-dd")).where(F.col("ts").isNotNull())
    return df.select("row_id", "subject", "relation", "object", "ts", F.unix_date("ts").cast("long").alias("day"))


def read_csv(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """Facts of a file; a header of the four field names, in any order, gives their order."""
    lines = read_lines(spark, path, encoding)
    head = lines.limit(1).collect()  # of the first partition, which has the smallest row_id; the rest is not read
    names = tuple(x.strip() for x in head[0]["line"].split(",")) if head else ()
    return repair_lines(lines, columns=names if sorted(names) == sorted(FIELDS) else FIELDS)


def parse_turtle(lines: DataFrame, prefix: str = "yago:", first_time: str = "2014") -> DataFrame:
    """Facts from (row_id, line): triples of `prefix` names; a time line sets the time of its triple and of all later
    ones, until the next. A year stands for its first day.

    A triple takes the time on the line after it, else the last time before it. The carried time needs the order of
    the whole file; it is found in two levels (last time within blocks of lines, then over the blocks).
    """
    name = rf"{prefix}([^\s;.]+)"
    triple = rf"^\s*{name}\s+{name}\s+{name}"
    time = F.regexp_extract("line", r'hasTime\s+"([^"]*)"', 1)
    df = lines.select("row_id", "line", F.when(time != "", time).alias("stamp"), F.floor(F.col("row_id") / 100_000).alias("block"))
    ends = df.where(F.col("stamp").isNotNull()).groupBy("block").agg(F.max_by("stamp", "row_id").alias("last"), F.min_by("stamp", "row_id").alias("first"), F.min("row_id").alias("first_at"))
    starts = df.groupBy("block").agg(F.max("row_id").alias("end")).join(ends, "block", "left")
    by_block = Window.orderBy("block")  # one row per 100,000 lines
    starts = starts.select("block", F.last("last", True).over(by_block.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.lead("first").over(by_block).alias("next_first"), (F.lead("first_at").over(by_block) == F.col("end") + 1).alias("adjacent"))
    inside = Window.partitionBy("block").orderBy("row_id")
    df = df.join(starts, "block")
    last = F.last("stamp", True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("next", F.coalesce(F.lead("stamp").over(inside), F.when(F.lead("row_id").over(inside).isNull() & F.col("adjacent"), F.col("next_first")))).withColumn("last", last)
    df = df.where(F.col("line").rlike(triple) & ~F.col("line").contains("hasTime"))
    stamp = F.coalesce("next", "last", "before", F.lit(first_time))
    ts = F.try_to_date(F.when(F.length(stamp) == 4, F.concat(stamp, F.lit("-01-01"))).otherwise(stamp), "yyyy-MM-dd")
    parts = [F.regexp_extract("line", triple, i).alias(c) for i, c in enumerate(("subject", "relation", "object"), 1)]
    return df.select("row_id", *parts, ts.alias("ts")).withColumn("day", F.unix_date("ts").cast("long"))


def load(spark: SparkSession, base: str) -> DataFrame:
    """Facts at `base`.csv, else `base`.ttl; FileNotFoundError if there is neither."""
    jvm = spark.sparkContext._jvm
    for suffix, reader in ((".csv", lambda p: read_csv(spark, p)), (".ttl", lambda p: parse_turtle(read_lines(spark, p, "utf-8")))):
        path = jvm.org.apache.hadoop.fs.Path(base + suffix)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return reader(base + suffix)
    raise FileNotFoundError(f"{base}.csv or {base}.ttl")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One value per line, blanks dropped."""
    return spark.read.text(path).select(F.btrim("value").alias("value")).where("value <> ''")


def distinct_lines(lines: DataFrame, key: str = "line", order: str = "row_id") -> DataFrame:
    """The first occurrence of each line, order kept as a column."""
    return lines.groupBy(key).agg(F.min(order).alias(order))


# --- sinks -----------------------------------------------------------------------------------------------------------


def nodes(facts: DataFrame) -> DataFrame:
    """Property-graph nodes (name, uri)."""
    names = facts.select(F.col("subject").alias("name")).union(facts.select("object")).distinct()
    return names.select("name", iri("name").alias("uri"))


def edges(facts: DataFrame) -> DataFrame:
    """Property-graph edges (src, dst, type, timestamp, timestamp_days, relation_uri)."""
    return facts.select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.col("relation").alias("type"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"), F.col("day").alias("timestamp_days"), iri("relation").alias("relation_uri"))


def write_graph(facts: DataFrame, path: str, clear: bool = True) -> None:
    mode = "overwrite" if clear else "append"
    nodes(facts).write.mode(mode).parquet(f"{path}/nodes")
    edges(facts).sortWithinPartitions("src", "timestamp_days").write.mode(mode).partitionBy("type").parquet(f"{path}/edges")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """The facts of a graph that write_graph() has written; row numbers follow time and names."""
    e = spark.read.parquet(f"{path}/edges").select(F.col("src").alias("subject"), F.col("type").cast("string").alias("relation"), F.col("dst").alias("object"), F.to_date("timestamp").alias("ts"), F.col("timestamp_days").alias("day"))
    placed = with_position(e.withColumn("n", F.row_number().over(Window.partitionBy("day", "subject", "relation", "object").orderBy("ts"))), ["day", "subject", "relation", "object", "n"], "row_id")
    return placed.select("row_id", "subject", "relation", "object", "ts", "day")


def iri(name: str, quotes: str = "drop") -> Column:
    """A name with underscores for spaces, and without quotes and angle brackets (drop), with single quotes as
    underscores (underscore), or with all signs as they are (keep)."""
    spaced = F.regexp_replace(name, r"\s+", "_")
    if quotes == "keep":
        return spaced
    return F.translate(spaced, "'", "_") if quotes == "underscore" else F.regexp_replace(spaced, "[\"'<>]", "")


def local_name(iri_: Column, prefix: str) -> Column:
    """An IRI without its prefix."""
    return F.replace(iri_, F.lit(prefix), F.lit(""))


def triples(facts: DataFrame) -> DataFrame:
    """Five triples per fact: its type, subject, relation, object and time."""
    row = lambda p, o: F.struct(F.lit(p).alias("p"), o.alias("o"))
    parts = F.array(row("type", F.lit("Event")), row("subject", F.col("subject")), row("relation", F.col("relation")), row("object", F.col("object")), row("timestamp", F.date_format("ts", "yyyy-MM-dd")))
    return facts.select(F.concat(F.lit("Event_"), "row_id").alias("s"), F.explode(parts).alias("x")).select("s", "x.p", "x.o")


def turtle_lines(facts: DataFrame, namespace: str = "http://example.org/") -> DataFrame:
    """One Turtle statement per fact, as a `value` column for write.text."""
    name = lambda c: F.concat(F.lit(f"<{namespace}"), iri(c), F.lit(">"))
    return facts.select(F.concat(name("subject"), F.lit(" "), name("relation"), F.lit(" "), name("object"), F.lit(' . # "'), F.date_format("ts", "yyyy-MM-dd"), F.lit('"^^xsd:date')).alias("value"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
