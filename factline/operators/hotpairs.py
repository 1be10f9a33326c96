"""Rule confidence of pairs with very many facts: in blocks, by summaries that are folded over them.

A pair's facts in time order are cut into blocks of BLOCK. What a fact needs to know of later blocks is little: for each
rule where the greedy match of its body's last k relations would end, when its first relation comes next, whether its
head comes at all, and the first few facts. A block's part of that is a summary; summaries are folded from the last
block to the first, which gives each block what it needs, and then each block judges its own facts. Only summaries of one
pair, one per BLOCK facts, stand in one group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factline.operators.order import with_position

BLOCK = 50_000
KEYS = ["subject", "object", "block"]
Rule = tuple[int, tuple[str, ...], str, float]

STATE = "ends array<long>, begins array<long>, heads array<boolean>, relations array<string>, days array<long>"
SUMMARY = f"subject string, object string, block long, matched array<int>, {STATE}"
INCOMING = f"subject string, object string, block long, {STATE}"
JUDGED = "subject string, object string, block long, rule int, matched long, upto long"

_kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def _fields(schema: str) -> list[tuple[str, pa.DataType]]:
    """Names and Arrow types of a schema of simple types and arrays of them."""
    out = []
    for part in schema.split(", "):
        name, kind = part.split(" ")
        inner = kind.removeprefix("array<").removesuffix(">")
        out.append((name, pa.list_(_kinds[inner]) if inner != kind else _kinds[kind]))
    return out


def _ordered(table: pa.Table) -> tuple[list[str], np.ndarray]:
    table = table.sort_by([("day", "ascending"), ("row_id", "ascending")])
    return table["relation"].to_pylist(), table["day"].to_numpy()


def _following(relations: np.ndarray, wanted: set[str]) -> dict[str, np.ndarray]:
    """For each wanted relation and place the first place from there on with that relation; the length without one."""
    n, out = len(relations), {}
    for r in wanted:
        at = np.where(relations == r, np.arange(n), n)
        out[r] = np.append(np.minimum.accumulate(at[::-1])[::-1], n)
    return out


def _suffixes(rules: list[Rule]) -> Iterator[tuple[int, tuple[str, ...]]]:
    """(rule's place, the last k relations of its body) for k = 1.., rule by rule."""
    for i, (_, body, _, _) in enumerate(rules):
        for k in range(1, len(body) + 1):
            yield i, body[-k:]


def _summaries(placed: DataFrame, rules: list[Rule]) -> DataFrame:
    longest = max(len(r[1]) for r in rules)
    wanted = {x for r in rules for x in (*r[1], r[2])}

    def run(keys: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        names, days = _ordered(table)
        following = _following(np.array(names, dtype=object), wanted)
        matched, ends = [], []
        for _, suffix in _suffixes(rules):
            at, count, end = 0, 0, None
            for r in suffix:
                p = following[r][at]
                if p == len(names):
                    break
                at, count, end = p + 1, count + 1, int(days[p])
            matched.append(count)
            ends.append(end)
        first = [following[r[1][0]][0] for r in rules]
        row = [*(k.as_py() for k in keys), matched, ends, [int(days[p]) if p < len(names) else None for p in first], [bool(following[r[2]][0] < len(names)) for r in rules], names[:longest], days[:longest].tolist()]
        return pa.Table.from_arrays([pa.array([v], k) for v, (_, k) in zip(row, _fields(SUMMARY))], names=[n for n, _ in _fields(SUMMARY)])

    return placed.groupBy(*KEYS).applyInArrow(run, SUMMARY)


def _incoming(summaries: DataFrame, rules: list[Rule]) -> DataFrame:
    """For each block what all later blocks of its pair amount to."""
    longest = max(len(r[1]) for r in rules)
    suffixes = [(i, len(s)) for i, s in _suffixes(rules)]
    place = {x: n for n, x in enumerate(suffixes)}

    def run(table: pa.Table) -> pa.Table:
        ends, begins, heads, relations, days = [None] * len(suffixes), [None] * len(rules), [False] * len(rules), [], []
        out = []
        for b in table.sort_by([("block", "descending")]).to_pylist():
            out.append({"subject": b["subject"], "object": b["object"], "block": b["block"], "ends": ends, "begins": begins, "heads": heads, "relations": relations, "days": days})
            ends = [b["ends"][n] if b["matched"][n] == k else ends[place[i, k - b["matched"][n]]] for n, (i, k) in enumerate(suffixes)]
            begins = [x if x is not None else y for x, y in zip(b["begins"], begins)]
            heads = [x or y for x, y in zip(b["heads"], heads)]
            relations, days = (b["relations"] + relations)[:longest], (b["days"] + days)[:longest]
        return pa.Table.from_pylist(out, schema=pa.schema(_fields(INCOMING)))

    return summaries.groupBy("subject", "object").applyInArrow(run, INCOMING)


def _judge(relations: np.ndarray, days: np.ndarray, rule: Rule, at: int, place: dict[tuple[int, int], int], following: dict[str, np.ndarray], later: dict) -> tuple[np.ndarray, np.ndarray]:
    """Whether each fact's attempt matches the body, and the head as well."""
    _, body, head, validity = rule
    n, m = len(days), len(body)
    names = np.concatenate([relations, np.array(later["relations"] + [None] * m, dtype=object)])
    times = np.concatenate([days.astype(float), np.array(later["days"], float), np.full(m, np.nan)])
    strict = times[m : n + m] - days <= validity
    for k, r in enumerate(body):
        strict &= names[k : n + k] == r
    number = lambda x: np.nan if x is None else float(x)
    p, end, open_ = np.arange(n), np.full(n, np.nan), np.ones(n, bool)
    begin = np.full(n, number(later["begins"][at]))
    for k, r in enumerate(body):
        found = following[r][np.minimum(p, n)]
        out = open_ & (found == n)
        end[out] = number(later["ends"][place[at, m - k]])
        open_ &= found < n
        if k == 0:
            begin[open_] = days[found[open_]]
        if k == m - 1:
            end[open_] = days[found[open_]]
        p = found + 1
    relaxed = end - begin <= validity  # false where either is missing
    comes = (following[head][:n] < n) | later["heads"][at]
    return strict | relaxed, np.where(strict, names[m : n + m] == head, relaxed & comes)


def confidences(facts: DataFrame, rules: list[Rule], block: int = BLOCK) -> DataFrame:
    """(rule_id, b, hb) as rules.confidences(), in blocks of `block` facts of a pair."""
    wanted = {x for r in rules for x in (*r[1], r[2])}
    place = {(i, len(s)): n for n, (i, s) in enumerate(_suffixes(rules))}
    placed = with_position(facts.select("subject", "object", "relation", "day", "row_id"), ["subject", "object", "day", "row_id"])
    placed = placed.withColumn("block", F.floor(F.col("position") / block)).drop("position")
    later = _incoming(_summaries(placed, rules), rules)

    def run(keys: tuple[pa.Scalar, ...], mine: pa.Table, told: pa.Table) -> pa.Table:
        names, days = _ordered(mine)
        relations = np.array(names, dtype=object)
        following, state = _following(relations, wanted), told.to_pylist()[0]
        rows = []
        for i, rule in enumerate(rules):
            matched, both = _judge(relations, days, rule, i, place, following, state)
            first = int(both.argmax()) if both.any() else None
            rows.append((*(k.as_py() for k in keys), i, int(matched.sum()), None if first is None else int(matched[: first + 1].sum())))
        return pa.Table.from_arrays([pa.array(c, k) for c, (_, k) in zip(zip(*rows), _fields(JUDGED))], names=[n for n, _ in _fields(JUDGED)])

    judged = placed.groupBy(*KEYS).cogroup(later.groupBy(*KEYS)).applyInArrow(run, JUDGED)
    pair = Window.partitionBy("subject", "object", "rule")
    judged = judged.withColumn("first", F.min(F.when(F.col("upto").isNotNull(), F.col("block"))).over(pair))
    counts = F.when(F.col("first").isNull() | (F.col("block") < F.col("first")), F.col("matched")).when(F.col("block") == F.col("first"), F.col("upto")).otherwise(0)
    by = judged.groupBy("rule").agg(F.sum(counts).alias("b"), F.count_if(F.col("block") == F.col("first")).alias("hb"))
    ids = F.array(*[F.lit(r[0]).cast("long") for r in rules])
    return by.select(F.get(ids, F.col("rule")).alias("rule_id"), "b", "hb")
