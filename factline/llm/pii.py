"""Personal data: known forms, and bootstrapped contextual extraction (DataFrame functions only).

Matches of the four known forms are seeds. An occurrence is an identifier-like string with the two words before it,
its pattern; a match before it counts as a word, <kind>, and so does the beginning of the text, ^. Patterns and
instances make a graph whose edges are scored in rounds: a pattern is worth the mean score of its distinct instances,
damped for few, if these scores add up to LEAST_SUPPORT; an instance is worth what its patterns leave together
(1 - product of (1 - pattern)), seeds 1. So what one round learns supports further patterns in the next. Instances of
high score that are no seeds are reported as `id`.

Words of a pattern may be of any length (a pattern of more than LONG_PATTERN bytes is named by its SHA-256); it reaches
back over two earlier matches of its kind at most.

Edge cases: null and empty texts have no spans; every input row gives one output row, repeated rows too; further
columns pass through `redact` and are ignored by `scan` (columns whose names start with "pii_" are replaced); an
empty table gives an empty result. Offsets count code points. Possessive patterns keep long texts linear; offsets,
overlaps and cuts are folds in runs (`text.running`), so texts with many matches take about linear time too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.llm.text import let, running
from factline.session import durable, forget

_part = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Possessive forms of the patterns; as no part can end otherwise, they match what the plain forms match.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){15,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "id": r"(?<![A-Za-z0-9._@+-])(?=[A-Za-z._@+-]*+[0-9])[A-Za-z0-9._@+-]{6,}+",
}
#: A character that a text must have for a pattern to match at all.
NEEDS = {"email": "@", "phone": "+", "ip": ".", "card": None, "id": None}
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "id")
SPAN = "struct<start:int,end:int,hit:string,left:string>"

LONG_PATTERN = 256
PIECE = 1024  # code points of a text that are searched for one offset
FAR = 2**31 - 1

ROUNDS = 3
LEAST_SUPPORT = 5
LEAST_PATTERN = 0.7
LEAST_INSTANCE = 0.8


def _luhn(digits: Column) -> Column:
    """Whether the string of digits passes Luhn's test."""
    n = F.char_length(digits)
    digit = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    value = lambda i: F.when(i % 2 == 0, digit(i)).otherwise(digit(i) * 2 - F.when(digit(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, "[^0-9]", "")
    if kind == "ip":
        return hit.rlike(rf"^{_part}\.{_part}\.{_part}\.{_part}$")
    if kind == "card":
        return F.when(F.char_length(digits).between(16, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.char_length(digits).between(8, 15)
    if kind == "id":
        return F.char_length(digits) >= 5
    return F.lit(True)


def _last_words(text: Column) -> Column:
    """The end of a text that holds its last two words, or all of it; anchored on the reversed text, so linear."""
    return F.reverse(F.regexp_extract(F.reverse(text), r"^(\s*+\S*+\s*+\S*+\s?)", 1))


def _pattern(before: Column) -> Column:
    two = F.lower(F.reverse(F.regexp_extract(F.reverse(before), r"^\s*+(\S++(?:\s++\S++)?)", 1)))
    return F.when(F.octet_length(two) > LONG_PATTERN, F.sha2(two.cast("binary"), 256)).otherwise(two)


def _located(df: DataFrame, kind: str) -> DataFrame:
    """Add pii_<kind>: array of SPAN, the valid matches. Offsets come from the lengths of matches and of what stands
    between them, which split() gives by the same search."""
    rx, none = PATTERNS[kind], F.array().cast(f"array<{SPAN}>")
    text, mark = F.col("text"), F.lit(f"<{kind}>")
    may = text.isNotNull() if not NEEDS[kind] else F.contains(text, F.lit(NEEDS[kind]))
    df = df.withColumn("pii_m", F.when(may, F.regexp_extract_all("text", F.lit(rx), F.lit(0))))
    df = df.withColumn("pii_g", F.when(F.size("pii_m") > 0, F.split("text", rx, -1)))
    gaps = F.transform("pii_g", lambda g: F.struct(F.char_length(g).alias("n"), _last_words(g).alias("end")))

    def spans(p: Column) -> Column:
        gap = lambda i: F.get(p["gaps"], i)

        def span(m: Column, i: Column) -> Column:
            start = F.get(p["before"], i) + gap(i)["n"]
            left = F.when(i == 0, F.concat(F.lit("^ "), gap(i)["end"])).when(i == 1, F.concat(F.lit("^ "), gap(i - 1)["end"], mark, gap(i)["end"]))
            left = left.otherwise(F.concat(mark, gap(i - 1)["end"], mark, gap(i)["end"]))
            return F.struct(start.alias("start"), (start + F.char_length(m)).alias("end"), m.alias("hit"), _pattern(left).alias("left"))

        return F.transform(p["hits"], span)

    def placed(p: Column) -> Column:
        lengths = F.transform(p["hits"], lambda m, i: F.char_length(m) + F.get(p["gaps"], i)["n"])
        before = running(lengths, F.lit(0), lambda a, x: a + x)
        return let(F.struct(p["hits"].alias("hits"), p["gaps"].alias("gaps"), before.alias("before")), spans)

    found = F.filter(let(F.struct(F.col("pii_m").alias("hits"), gaps.alias("gaps")), placed), lambda x: _valid(kind, x["hit"]))
    return df.withColumn(f"pii_{kind}", F.when(F.size("pii_m") > 0, found).otherwise(none)).drop("pii_m", "pii_g")


def _outside(spans: Column, taken: Column) -> Column:
    """The elements of `spans` that overlap none of `taken`: in the order of starts, none before reaches into them
    and none after begins in them."""
    mark = lambda own: lambda x, i: F.struct(x["start"].alias("start"), F.lit(own).alias("own"), x["end"].alias("end"), i.alias("i"))
    marks = F.array_sort(F.concat(F.transform(taken, mark(0)), F.transform(spans, mark(1))))

    def chosen(ms: Column) -> Column:
        reach = running(F.transform(ms, lambda m: F.when(m["own"] == 0, m["end"]).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
        begins = F.reverse(F.transform(ms, lambda m: F.when(m["own"] == 0, m["start"]).otherwise(FAR)))
        following = F.reverse(running(begins, F.lit(FAR), lambda a, x: F.least(a, x)))
        free = lambda q: lambda m, k: (m["own"] == 1) & (F.get(q["reach"], k) <= m["start"]) & (F.get(q["next"], k) >= m["end"])
        return let(F.struct(reach.alias("reach"), following.alias("next")), lambda q: F.filter(ms, free(q)))

    return let(spans, lambda own: F.transform(let(marks, chosen), lambda m: F.get(own, m["i"])))


def occurrences(docs: DataFrame, kept: list[str]) -> DataFrame:
    """pii_row (unique), the columns `kept`, and pii_<kind> for each kind; written, so that row numbers stay."""
    df = docs.select(*[c for c in docs.columns if c in kept or c == "text"])
    for kind in KINDS:
        df = _located(df, kind)
    df = df.withColumn("pii_base", F.concat(*[F.col(f"pii_{k}") for k in BASE]))
    both = (F.size("pii_id") > 0) & (F.size("pii_base") > 0)
    df = df.withColumn("pii_id", F.when(both, _outside(F.col("pii_id"), F.col("pii_base"))).otherwise(F.col("pii_id"))).drop("pii_base")
    return durable(df.select(F.monotonically_increasing_id().alias("pii_row"), *kept, *[f"pii_{k}" for k in KINDS]), "pii")


def pattern_edges(found: DataFrame) -> DataFrame:
    """(pattern, hit, seed), written: the pattern-instance graph of all occurrences, one row per pattern and hit."""
    as_edge = lambda kind: lambda x: F.struct(x["left"].alias("pattern"), x["hit"].alias("hit"), F.lit(kind != "id").alias("seed"))
    array = F.concat(*[F.transform(f"pii_{k}", as_edge(k)) for k in KINDS])
    edges = found.select(F.explode(array).alias("x")).select("x.*").groupBy("pattern", "hit").agg(F.max("seed").alias("seed"))
    return durable(edges, "pii-edges")


def learn(edges: DataFrame, rounds: int = ROUNDS, least_support: float = LEAST_SUPPORT, least_pattern: float = LEAST_PATTERN, least_instance: float = LEAST_INSTANCE) -> DataFrame:
    """(hit, score): unseen identifiers of high score after `rounds` on the graph of pattern_edges().

    What patterns and instances are worth is written before it meets the edges, so that adaptive execution can split the
    edges of a very common pattern or instance.
    """
    scored = edges.withColumn("score", F.col("seed").cast("double"))
    for _ in range(rounds):
        patterns = scored.groupBy("pattern").agg((F.sum("score") / (F.count("*") + 1)).alias("worth"), F.sum("score").alias("support"))
        patterns = patterns.where((F.col("support") >= least_support) & (F.col("worth") >= least_pattern)).drop("support")
        patterns = durable(patterns, "pii-patterns")
        left = F.sum(F.log1p(-F.least("worth", F.lit(0.999999))))
        instances = edges.join(patterns, "pattern").groupBy("hit").agg((1 - F.exp(left)).alias("learned"))
        instances = durable(instances, "pii-instances")
        scored = edges.join(instances, "hit", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("learned", F.lit(0.0)))).drop("learned")
    return scored.where(~F.col("seed") & (F.col("score") >= least_instance)).groupBy("hit").agg(F.max("score").alias("score"))


def with_learned(found: DataFrame, **settings: float) -> DataFrame:
    """`found` with pii_id cut down to the learned identifiers."""
    edges = pattern_edges(found)
    learned = durable(learn(edges, **settings), "pii-learned")
    forget(edges)
    # rows without candidates, and their texts, stay where they are
    some, none = found.where(F.size("pii_id") > 0), found.where(F.size("pii_id") == 0)
    spans = (
        some.select(F.col("pii_row").alias("l_row"), F.explode("pii_id").alias("x"))
        .join(learned, F.col("x.hit") == F.col("hit"), "left_semi")
        .groupBy("l_row")
        .agg(F.array_sort(F.collect_list("x")).alias("l_id"))
    )
    some = some.join(spans, F.col("pii_row") == F.col("l_row"), "left").withColumn("pii_id", F.coalesce("l_id", F.array().cast(f"array<{SPAN}>")))
    return some.select(*found.columns).union(none)


def _written(kinds: tuple[str, ...]) -> Column:
    """kind:start:end of all spans, by kind as listed, then start, comma-joined."""
    write = lambda kind: lambda x: F.concat(F.lit(f"{kind}:"), x["start"], F.lit(":"), x["end"])
    return F.array_join(F.concat(*[F.transform(f"pii_{k}", write(k)) for k in kinds]), ",")


def scan(docs: DataFrame, **settings: float) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_id, base_sha256, spans."""
    found = with_learned(occurrences(docs, ["doc_id"]), **settings)
    return found.select("doc_id", *[F.size(f"pii_{k}").cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(_written(BASE).cast("binary"), 256).alias("base_sha256"), _written(KINDS).alias("spans"))


def redact(docs: DataFrame, **settings: float) -> DataFrame:
    """`docs` with each span's text replaced by <kind>; of overlapping spans the first, then the longer, gives the
    name, and all of their characters go. n_chars follows; the columns stay."""
    own = {c: "text" if c == "text" else f"own{i}" for i, c in enumerate(docs.columns)}  # no name of theirs can clash
    inner = docs.select(*[F.col(f"`{c}`").alias(o) for c, o in own.items()])
    found = with_learned(occurrences(inner, inner.columns), **settings)
    tag = lambda kind: lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("minus_end"), F.lit(kind).alias("kind"))
    tagged = F.concat(*[F.transform(f"pii_{k}", tag(k)) for k in KINDS])
    found = found.withColumn("pii_all", F.array_sort(tagged)).withColumn("pii_n", F.size("pii_all"))
    pieces = F.regexp_extract_all("text", F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))

    def between(p: Column, a: Column, b: Column) -> Column:
        """Characters a to b (exclusive) of the text whose pieces are p."""
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        whole = F.array_join(F.slice(p, first + 2, last - first - 1), "")
        apart = F.concat(F.substring(F.get(p, first), a % PIECE + 1, F.lit(PIECE)), whole, F.substring(F.get(p, last), F.lit(1), b - last * PIECE))
        return F.when(a >= b, "").when(first == last, F.substring(F.get(p, first), a % PIECE + 1, b - a)).otherwise(apart)

    def cut(p: Column) -> Column:
        fresh = lambda x, k: F.when(x["start"] >= F.get(p["done"], k), F.concat(between(p["pieces"], F.get(p["done"], k), x["start"]), F.lit("<"), x["kind"], F.lit(">"))).otherwise("")
        return F.concat(F.array_join(F.transform(p["all"], fresh), ""), between(p["pieces"], p["end"], p["n"]))

    ends = F.transform("pii_all", lambda x: -x["minus_end"])
    done = running(ends, F.lit(0), lambda a, x: F.greatest(a, x))
    bound = F.struct(pieces.alias("pieces"), F.col("pii_all").alias("all"), done.alias("done"), F.array_max(ends).alias("end"), F.char_length("text").alias("n"))
    found = found.withColumn("pii_text", F.when(F.col("pii_n") > 0, let(bound, cut)).otherwise(F.col("text")))
    changed = {"text": F.col("pii_text")}
    if "n_chars" in own:
        changed["n_chars"] = F.when(F.col("pii_n") > 0, F.char_length("pii_text")).otherwise(F.col(own["n_chars"])).cast(docs.schema["n_chars"].dataType)
    return found.select(*[changed.get(c, F.col(o)).alias(c) for c, o in own.items()])
