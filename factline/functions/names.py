"""Names, sentences, vectors, rules and replies as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sentence(subject: str, relation: str, object_: str, ts: str) -> Column:
    """A fact in words: underscores as spaces, the relation in lower case, the date at the end."""
    spaced = lambda c: F.translate(c, "_", " ")
    return F.concat(spaced(subject), F.lit(" "), F.lower(spaced(relation)), F.lit(" "), spaced(object_), F.lit(" on "), F.date_format(ts, "yyyy-MM-dd"))


def cosine(a: Column, b: Column) -> Column:
    """0 for a vector of norm 0, 0.3 where a vector is missing."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull(), 0.3).when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def name_similarity(a: Column, b: Column) -> Column:
    """Mean of a score of the common prefix and one of the common words, within [0.1, 1]; equal names 1."""
    n = F.least(F.length(a), F.length(b))
    # no step of the score looks beyond five common characters
    same = lambda i: (n >= i) & (F.substring(a, 1, i) == F.substring(b, 1, i))
    by_prefix = F.when(same(5), 0.5 + 0.1 * 5).when(same(4), 0.5 + 0.1 * 4).when(same(3), 0.3 + 0.1 * 3).when(same(2), 0.3 + 0.1 * 2).otherwise(0.2)
    words = lambda x: F.filter(F.split(x, r"\s+"), lambda w: w != "")
    shared = F.size(F.array_intersect(words(a), words(b)))
    by_words = F.when(shared > 0, 0.3 + 0.2 * F.least(shared, F.lit(3))).otherwise(0.2)
    # different names of one word each share none, and need not be cut
    by_words = F.when(a.rlike(r"\s") | b.rlike(r"\s"), by_words).otherwise(0.2)
    return F.when(a == b, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.1), (by_prefix + by_words) / 2)))


def rule_signature(head: Column, body: Column) -> Column:
    return F.concat(head, F.lit("<-"), F.array_join(body, "_"))


def rule_text(head: Column, body: Column) -> Column:
    """head(X0,Xn) <- b1(X0,X1) ^ b2(X1,X2) ..."""
    atoms = F.transform(body, lambda r, i: F.concat(r, F.lit("(X"), i.cast("string"), F.lit(",X"), (i + 1).cast("string"), F.lit(")")))
    return F.concat(head, F.lit("(X0,X"), F.size(body).cast("string"), F.lit(") <- "), F.array_join(atoms, " ^ "))


def path_text(number: Column, path: Column) -> Column:
    """Path_i: (s, r, o, t=..) → ..."""
    step = lambda x: F.concat(F.lit("("), x["subject"], F.lit(", "), x["relation"], F.lit(", "), x["object"], F.lit(", t="), F.date_format(F.date_from_unix_date(x["day"].cast("int")), "yyyy-MM-dd"), F.lit(")"))
    return F.concat(F.lit("Path_"), number.cast("string"), F.lit(": "), F.array_join(F.transform(path, step), " → "))


def path_range(path: Column) -> Column:
    """Struct (first, last, span) of a path's days."""
    days = F.transform(path, lambda x: x["day"])
    first, last = F.array_min(days), F.array_max(days)
    return F.struct(first.alias("first"), last.alias("last"), (last - first).alias("span"))


def path_entities(path: Column) -> Column:
    """The entities of a path, each once, in order of their names."""
    return F.array_sort(F.array_union(F.transform(path, lambda x: x["subject"]), F.transform(path, lambda x: x["object"])))


def rule_json(head: Column, body: Column, **values: Column) -> Column:
    """A rule as JSON: its relations, its signature and the values given by name."""
    return F.to_json(F.struct(head.alias("head"), body.alias("body"), rule_signature(head, body).alias("signature"), *[c.alias(n) for n, c in values.items()]))


def chain_name(relation: Column, number: Column) -> Column:
    return F.concat(F.lit("pattern_"), number.cast("string"), F.lit("_"), relation)


def chain_validity(mean_span: Column) -> Column:
    return F.greatest(F.lit(7), F.least(F.lit(365), (2 * mean_span).cast("int")))


def reply_score(reply: Column) -> Column:
    """The first number of a model's reply, clipped to [0, 1]; null without one."""
    number = F.regexp_extract(reply, r"([0-9]+(?:\.[0-9]+)?|\.[0-9]+)", 1)
    return F.when(number != "", F.least(F.lit(1.0), F.greatest(F.lit(0.0), number.cast("double"))))


def reply_scores(reply: Column) -> Column:
    """Name -> score of a JSON object anywhere in a reply; null without one."""
    return F.from_json(F.regexp_extract(reply, r"(?s)(\{.*\})", 1), "map<string,double>")
