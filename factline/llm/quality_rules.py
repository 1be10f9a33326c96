"""Quality rules as a short-circuit cascade (DataFrame functions only).

The cost of each step that makes measures, and which rules reject what, are estimated on a bounded sample. Rules then
run in the order of rejections per second: of the rules left, next is that which rejects most of the sample rows still
alive for each second of the steps that no rule before it has paid for. What a rule needs is only computed for rows that
no earlier rule has rejected. The order changes the work, never the verdict: a document is kept when no rule rejects it.
Measures that the caller wants for every row (`keep_measures`) come first and are free to all rules; op7 wants five of
the eight, so that there only letters are skipped, while the pipeline wants none.

The sample is the first texts of the table up to SAMPLE_TEXT_BYTES each, so its rates are those of the first partitions.

Edge cases: null and empty texts have no words, so the rule `short` rejects them; every input row gives one output
row, repeated rows and repeated doc_ids too; further columns pass through (columns whose names start with "q7_" are
working columns and are replaced); an empty table gives an empty result. Within one text two different 5-word
windows count as equal if their 64-bit hashes are (about 1e-11 for a text of 20,000 words).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.llm.text import SPACES, spaced_words

SAMPLE_ROWS = 300
SAMPLE_TEXT_BYTES = 20_000
TIMED_BYTES = 3_000_000  # the sample is repeated up to this size, so that times are those of the work


@dataclass(frozen=True)
class Rule:
    """Rejects a row where `reject` (a condition on measures) is true; `needs` names the measures."""

    name: str
    needs: tuple[str, ...]
    reject: Callable[[], Column]


def _m(name: str) -> Column:
    return F.col(f"q7_{name}")


RULES = (
    Rule("short", ("n_words",), lambda: _m("n_words") < 10),
    Rule("repeats", ("n_words", "n_repeat_words"), lambda: 100 * _m("n_repeat_words") > 20 * _m("n_words")),
    Rule("symbols", ("word_chars", "n_symbols"), lambda: 10 * _m("n_symbols") > _m("word_chars")),
    Rule("lines", ("n_lines", "n_dup_lines"), lambda: 100 * _m("n_dup_lines") > 30 * _m("n_lines")),
    Rule("word_length", ("n_words", "word_chars"), lambda: (_m("word_chars") < 2 * _m("n_words")) | (_m("word_chars") > 25 * _m("n_words"))),
    Rule("shouting", ("n_upper", "n_lower"), lambda: _m("n_upper") > _m("n_lower")),
)
BASE = ("short", "repeats")


def _words(df: DataFrame, alive: Column) -> DataFrame:
    df = df.withColumn("q7_words", F.when(alive, spaced_words(F.col("text"))))
    return df.withColumn("q7_n_words", F.size("q7_words").cast("long"))


def _word_chars(df: DataFrame, alive: Column) -> DataFrame:
    bare = F.translate(F.coalesce("text", F.lit("")), SPACES, "")
    return df.withColumn("q7_word_chars", F.when(alive, F.char_length(bare).cast("long")))


def _symbols(df: DataFrame, alive: Column) -> DataFrame:
    return df.withColumn("q7_n_symbols", F.when(alive, F.coalesce(F.regexp_count("text", F.lit(r"[#*$%&|<>]")), F.lit(0)).cast("long")))


def _lines(df: DataFrame, alive: Column) -> DataFrame:
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = df.withColumn("q7_lines", F.when(alive, lines))
    df = df.withColumn("q7_n_lines", F.size("q7_lines").cast("long"))
    return df.withColumn("q7_n_dup_lines", _m("n_lines") - F.size(F.array_distinct("q7_lines")))


def _repeats(df: DataFrame, alive: Column) -> DataFrame:
    """Words in 5-word windows that occur twice or more in the text.

    The windows' hashes are sorted only where some repeat; consecutive repeated windows overlap, so each adds the
    words up to the next one's start, five at most.
    """
    windows = F.transform(F.sequence(F.lit(0), _m("n_words").cast("int") - 5), lambda i: F.xxhash64(*[F.get("q7_words", i + j) for j in range(5)]))
    df = df.withColumn("q7_hashes", F.when(alive & (_m("n_words") >= 6), windows))
    df = df.withColumn("q7_again", F.size("q7_hashes") > F.size(F.array_distinct("q7_hashes")))
    df = df.withColumn("q7_sorted", F.when(F.col("q7_again"), F.sort_array(F.transform("q7_hashes", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    near = lambda x, k: F.coalesce(F.get("q7_sorted", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("q7_sorted", k + 1)["h"] == x["h"], F.lit(False))
    df = df.withColumn("q7_starts", F.sort_array(F.transform(F.filter("q7_sorted", near), lambda x: x["i"])))
    added = F.transform("q7_starts", lambda x, k: F.least(F.lit(5), F.coalesce(F.get("q7_starts", k + 1) - x, F.lit(5))))
    total = F.aggregate(added, F.lit(0), lambda a, x: a + x)
    return df.withColumn("q7_n_repeat_words", F.when(alive, F.coalesce(total, F.lit(0)).cast("long")))


def _letters(df: DataFrame, alive: Column) -> DataFrame:
    count = lambda kind: F.coalesce(F.regexp_count("text", F.lit(kind)), F.lit(0)).cast("long")
    return df.withColumn("q7_n_upper", F.when(alive, count(r"\p{Lu}"))).withColumn("q7_n_lower", F.when(alive, F.char_length(F.coalesce("text", F.lit(""))) - count(r"[^\p{Ll}]")))


#: What makes a measure, and what that needs first.
STEPS: dict[str, tuple[tuple[str, ...], Callable[[DataFrame, Column], DataFrame]]] = {
    "n_words": ((), _words),
    "word_chars": ((), _word_chars),
    "n_symbols": ((), _symbols),
    "n_lines": ((), _lines),
    "n_dup_lines": ((), _lines),
    "n_repeat_words": (("n_words",), _repeats),
    "n_upper": ((), _letters),
    "n_lower": ((), _letters),
}


def measure(df: DataFrame, names: tuple[str, ...], alive: Column | None = None) -> DataFrame:
    """Add the measures `names` (as q7_<name>) that `df` lacks; null where `alive` is false."""
    for name in names:
        if f"q7_{name}" not in df.columns:
            needs, step = STEPS[name]
            df = step(measure(df, needs, alive), F.lit(True) if alive is None else alive)
    return df


@dataclass(frozen=True)
class Estimates:
    """seconds: of each step, by the name of its function; rejects: of each sample row, whether each rule rejects it."""

    seconds: dict[str, float]
    rejects: list[tuple[bool, ...]]


def steps_of(names: tuple[str, ...]) -> set[str]:
    """The steps that make the measures `names`, and those they need."""
    return {x for n in names for needs, step in [STEPS[n]] for x in (step.__name__, *steps_of(needs))}


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS) -> Estimates:
    """On at most `rows` texts of at most SAMPLE_TEXT_BYTES bytes, repeated to TIMED_BYTES for the times.

    A step's time is that of a second run of its measures, less that of the steps it needs or of a job that only reads.
    limit() before collect() reads partitions one after the other until it has enough rows, not the whole table.
    """
    got = docs.select("text").where(F.octet_length("text") <= SAMPLE_TEXT_BYTES).limit(rows).collect()
    sample = docs.sparkSession.createDataFrame([(r[0],) for r in got], "text string").coalesce(1)
    every = tuple(dict.fromkeys(n for r in rules for n in r.needs))
    judged = measure(sample, every).select(*[F.coalesce(r.reject(), F.lit(False)).alias(r.name) for r in rules])
    rejects = [tuple(r) for r in judged.collect()]
    times = max(1, TIMED_BYTES // max(1, sum(len(r[0]) for r in got)))
    long = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(times))))

    def seconds(names: tuple[str, ...]) -> float:
        job = measure(long, names).agg(F.sum(F.octet_length("text")), *[F.sum(f"q7_{n}") for n in names])
        job.collect()  # compiles
        began = time.perf_counter()
        job.collect()
        return time.perf_counter() - began

    alone = {(): seconds(())}
    out = {}
    for step in steps_of(every):
        made = tuple(n for n in every if STEPS[n][1].__name__ == step) or tuple(n for n in STEPS if STEPS[n][1].__name__ == step)
        needs = STEPS[made[0]][0]
        if needs not in alone:
            alone[needs] = seconds(needs)
        out[step] = max(1e-6, seconds(made) - alone[needs])
    return Estimates(out, rejects)


def order(rules: tuple[Rule, ...], estimates: Estimates, made: tuple[str, ...] = ()) -> list[Rule]:
    """Most rejections per second first; among rules that reject nothing more, the cheapest. made: measures that cost
    nothing any more."""
    left, paid, alive, out = list(rules), steps_of(made), list(estimates.rejects), []
    while left:
        cost = {r.name: sum(estimates.seconds.get(s, 0.0) for s in steps_of(r.needs) - paid) for r in left}
        count = {r.name: sum(row[rules.index(r)] for row in alive) for r in left}
        best = max(left, key=lambda r: (count[r.name] / max(cost[r.name], 1e-6), -cost[r.name]))
        left.remove(best)
        out.append(best)
        paid |= steps_of(best.needs)
        alive = [row for row in alive if not row[rules.index(best)]]
    return out


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, estimates: Estimates | None = None, keep_measures: tuple[str, ...] = (), verdict: str = "kept") -> DataFrame:
    """`docs` with the column `verdict`, and with the measures `keep_measures` for every row; they replace columns of
    these names, all others stay.

    estimates: as estimate() gives; taken from a sample of `docs` if None.
    """
    names = docs.columns
    made = {x.lower() for x in (verdict, *keep_measures)}
    own = {f"own{i}": c for i, c in enumerate(names) if c.lower() not in made}  # no name of theirs can clash
    ranked = order(rules, estimate(docs, rules) if estimates is None else estimates, keep_measures)
    inner = docs.select("text", *[F.col(f"`{c}`").alias(o) for o, c in own.items()])
    df = measure(inner, keep_measures).withColumn("q7_alive", F.lit(True))
    for rule in ranked:
        df = measure(df, rule.needs, F.col("q7_alive"))
        df = df.withColumn("q7_alive", F.col("q7_alive") & ~F.coalesce(rule.reject(), F.lit(False)))
    # A column of rand() keeps the optimizer from pushing later conditions on `kept` below the measures, where it would
    # repeat their expressions inside one another.
    df = df.withColumn("q7_guard", F.rand())
    return df.select(*[F.col(o).alias(c) for o, c in own.items()], *[_m(m).alias(m) for m in keep_measures], (F.col("q7_alive") & (F.col("q7_guard") >= 0)).alias(verdict))


def base_failed() -> Column:
    """The base verdict, from the measures n_words and n_repeat_words."""
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
