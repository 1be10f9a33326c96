"""Mixing sources to target weights along a time-varying curriculum.

Training time runs from 0 to 1. Each source has a weight schedule w(t) = start + (end - start) * t; the integral of
its schedule, scaled to the source's target, is its cumulative token demand. Documents of a source stand in a fixed
pseudo-random order and may be used twice; a use's place in the cumulative tokens of its source, the second pass
following the first, is inverted through the demand to a training position, and the mix is range-sorted by position.

Sources are ordered by code point with null last and weigh 3, 1, 2, repeating. Together they share 150 % of all
words; a target stops at twice its source's words and the excess is shared again by weight, so that
target = min(2 * size, level * weight), with one level for all sources.

Edge cases: null and empty texts have size 0 and take nothing; a null source is a source of its own; repeated rows
are separate rows and may swap places among themselves; an empty table gives an empty result; further columns pass
through, but for those named as a result column, which are replaced. The last document of a source's demand is cut,
so the words taken differ from the target by rounding alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factline.llm.text import SPACES
from factline.operators.order import with_position
from factline.session import durable

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
EPOCHS = 2
ROWS_PER_BUCKET = 2_000
WORKING = ("key", "bucket", "inside", "begin", "want", "weight", "bucket_start", "p_source", "p_bucket", "uses", "use")


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`; null: 0."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, weight, target) from one row (source, source_size) per source.

    Sources may be as many as hosts: their order comes from a range-partitioned sort, and the level from rounds of one
    aggregate each. In a round those whose cap is below the level so far are capped and the others share what is left;
    the level only rises, so the rounds end when no source is added.
    """
    named = sizes.select("source", "source_size", F.col("source").isNull().alias("unnamed"), F.encode("source", "UTF-8").alias("code"))
    placed = with_position(named, ["unnamed", "code"])
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    df = placed.select("source", "source_size", w.alias("weight"), (F.lit(float(epochs)) * F.col("source_size")).alias("cap"))
    df = durable(df, "weights")
    total = share * (df.agg(F.sum("source_size")).collect()[0][0] or 0)
    level, capped = 0.0, -1
    while True:
        stops = F.col("cap") <= F.lit(level) * F.col("weight")
        n, held, open_weight = df.agg(F.count_if(stops), F.sum(F.when(stops, F.col("cap"))), F.sum(F.when(~stops, F.col("weight")))).collect()[0]
        if n == capped or not open_weight:
            break
        level, capped = (total - (held or 0.0)) / open_weight, n
    return df.select("source", "source_size", "weight", F.when(F.col("cap") <= F.lit(level) * F.col("weight"), F.col("cap")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def position(share_done: Column, start: Column, end: Column) -> Column:
    """The time t in [0, 1] at which the integral of start + (end - start) * t reaches `share_done` of its whole."""
    area = (start + end) / 2 * share_done
    return F.least(F.lit(1.0), 2 * area / (start + F.sqrt(start * start + 2 * (end - start) * area)))


def _placed(docs: DataFrame, made: tuple[str, ...], weights: tuple[float, ...], share: float, epochs: int, early: float, late: float, seed: int, carry: bool) -> tuple[DataFrame, list[str]]:
    """The rows of docs with size, source_size, target and `uses`, an array of (epoch, taken, position) by epoch; and
    the columns to keep. Columns of docs named as in `made` are dropped, those named as in WORKING renamed."""
    docs = docs.drop(*made) if carry else docs.select("doc_id", "source", "text")
    docs = docs.withColumnsRenamed({c: f"mix_{c}" for c in docs.columns if c in WORKING})
    kept = docs.columns if carry else ["doc_id"]
    # 40 bits of md5, which other engines also have
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("-"), F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary"))))  # rows without doc_id spread by text
    key = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 10), 16, 10).cast("long")
    buckets = max(1, -(-docs.count() // ROWS_PER_BUCKET))
    bucket = F.floor(key / ((1 << 40) / buckets)).cast("int")
    sized = docs.select(*kept, *[c for c in ("doc_id", "source") if c not in kept], word_count(F.col("text")).alias("size"), key.alias("key"), bucket.alias("bucket"))
    # running sums in two levels, so that no task needs a whole source: buckets within the source, rows within the bucket
    sums = durable(sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")), "sums")
    goal = targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, epochs)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("bucket_start", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)))
    plan = sums.alias("s").join(goal.alias("g"), F.col("s.source").eqNullSafe(F.col("g.source"))).select(F.col("s.source").alias("p_source"), F.col("s.bucket").alias("p_bucket"), "bucket_start", "source_size", "weight", "target")
    mean_weight = sum(weights) / len(weights)
    rate = lambda first, last: F.when(F.col("weight") > mean_weight, first).when(F.col("weight") < mean_weight, last).otherwise(1.0)
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        sized.withColumn("inside", F.sum("size").over(inside) - F.col("size"))
        .join(plan, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("bucket") == F.col("p_bucket")))
        .withColumn("begin", F.col("bucket_start") + F.col("inside"))
        .withColumn("want", F.round("target").cast("long"))
    )
    start, end = rate(early, late), rate(late, early)

    def use(e: int) -> Column:
        passed = F.col("begin") + e * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("want") - passed)).cast("long")
        return F.struct(F.lit(e).alias("epoch"), words.alias("taken"), position(F.try_divide(passed, "target"), start, end).alias("position"))

    return placed.withColumn("uses", F.filter(F.array(*map(use, range(epochs))), lambda x: x["taken"] > 0)), kept


def _sorted(df: DataFrame) -> DataFrame:
    df = df.withColumnsRenamed({f"mix_{c}": c for c in WORKING})
    return df.repartitionByRange(F.col("position").asc_nulls_last(), F.col("doc_id")).sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


def uses(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, early: float = 1.5, late: float = 0.5, seed: int = 8, carry: bool = False, unused: bool = False) -> DataFrame:
    """The mix: doc_id, size, source_size, target, epoch, taken, position, one row per use, sorted by position in
    ranges. taken: the words of this use; epoch: 0 for a document's first use. Unused documents have no row;
    with `unused` they follow all others, with 0 words and neither epoch nor position.

    Sources of weight above the mean fade from `early` to `late` times their mean rate, those below rise from `late`
    to `early`, others stay level. carry: keep all of docs' columns.
    """
    made = ("size", "source_size", "target", "epoch", "taken", "position")
    placed, kept = _placed(docs, made, weights, share, epochs, early, late, seed, carry)
    each = placed.select(*kept, "size", "source_size", "target", (F.explode_outer if unused else F.explode)("uses").alias("use"))
    return _sorted(each.select(*kept, "size", "source_size", "target", "use.epoch", F.coalesce("use.taken", F.lit(0)).alias("taken"), "use.position"))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, early: float = 1.5, late: float = 0.5, seed: int = 8, carry: bool = False) -> DataFrame:
    """uses() summed to one row per row of docs: doc_id, size, source_size, target, taken, position, last_position.

    taken: the words of all uses (0 if unused); position: of the first use, by which rows are sorted, last_position: of
    the last one (both null if unused; equal if there is one use).
    """
    made = ("size", "source_size", "target", "taken", "position", "last_position")
    placed, kept = _placed(docs, made, weights, share, epochs, early, late, seed, carry)
    taken = F.aggregate("uses", F.lit(0).cast("long"), lambda n, x: n + x["taken"])
    at = lambda i: F.get("uses", i)["position"]
    return _sorted(placed.select(*kept, "size", "source_size", "target", taken.alias("taken"), at(F.lit(0)).alias("position"), at(F.size("uses") - 1).alias("last_position")))
