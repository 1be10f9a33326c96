"""N-gram Jaccard join, size-aware: small sets meet in enumerated subsets, large sets in inverted lists.

A document's set is its distinct 5-word shingles (with fewer words, the whole sequence as one). Documents with equal
sets are one class, represented by the smallest doc_id. Two classes of sizes a <= b link when their overlap reaches
ceil(3 (a + b) / 7), which is Jaccard similarity of 0.75. Two such sets share

* for small sizes: a subset of that fixed size, so the hash of each such subset is a key;
* for large sizes: one of their first n - ceil(3 n / 4) + 1 shingles in any common order, so each of these is a key.
  The order is by document frequency, rare first; a set with that many shingles of its own links with nothing.

The boundary between small and large is the size at which enumerating subsets costs as much as scanning the lists.

Lists are scanned in rounds. In each the first classes of every list lead: they are paired with the others of the list
that sizes and positions in the common order allow to link and that verified links have not joined to them yet, each
pair is compared exactly, and components are formed from verified links alone. Then the leaders leave, and so do lists
whose sets are all in one component. The first round has one leader a list, so a large group of copies is joined by as
many comparisons as it has members; later rounds have GROWTH times as many, so the number of rounds is the logarithm of
the longest list. What is compared beyond that are sets that could link by size and position and do not.

Edge cases: null, empty and wordless texts have empty sets and link with nothing; every input row gives one output
row; rows that repeat a doc_id count as one document with several sets; a null doc_id joins its class without naming
it; further columns are ignored by `join` and kept by `keep_one`; an empty table gives an empty result. Shingles are
compared by 64-bit hashes, sets by 128-bit ones.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from factline.llm.components import connected_components
from factline.llm.counting import count_keys
from factline.llm.text import SPACED, Words, blocks, fmix, free_name
from factline.session import durable, forget

SHINGLE = 5
NUMERATOR, DENOMINATOR = 75, 100
SMALL_MOST = 12  # the boundary is sought up to this size
GROWTH = 32  # of the number of leaders per list from round to round
U = np.uint64


def overlap_needed(a: int, b: int) -> int:
    """The least intersection of linked sets of sizes a and b."""
    return -(-NUMERATOR * (a + b) // (NUMERATOR + DENOMINATOR))


def prefix_length(n: int) -> int:
    return n - -(-NUMERATOR * n // DENOMINATOR) + 1


def partner_sizes(n: int) -> range:
    return range(-(-NUMERATOR * n // DENOMINATOR), DENOMINATOR * n // NUMERATOR + 1)


def subset_count(n: int) -> int:
    """How many subset keys a set of n has."""
    return sum(math.comb(n, overlap_needed(n, b)) for b in partner_sizes(n))


def sets_of(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out: list[np.ndarray] = []
    for a, b in blocks(texts):
        words = Words(texts[a:b], SPACED)
        grams, at = words.ngrams(SHINGLE)
        cut = np.searchsorted(words.doc[at], np.arange(b - a + 1)) if len(at) else np.zeros(b - a + 1, int)
        for d in range(b - a):
            n = int(words.count[d])
            if n >= SHINGLE:
                out.append(np.unique(grams[cut[d] : cut[d + 1]]))
            elif n:
                h = np.array([n], U)
                for i in range(words.first[d], words.first[d + 1]):
                    h = fmix(h * U(0x9E3779B97F4A7C15) + words.hash[i : i + 1])
                out.append(h)
            else:
                out.append(np.zeros(0, U))
    return out


SETS = "doc_id long, n int, sig binary, scan_cost long, tokens array<long>, keys array<long>"


def _sets(rows: pa.Table, totals) -> pa.Table:
    """A row of SETS per text; tokens and keys only where the set may have a partner."""
    sets = sets_of(rows["text"].to_pylist())
    every = np.concatenate(sets) if sets else np.zeros(0, U)
    frequency = totals(every)
    sig, cost, tokens, keys, at = [], [], [], [], 0
    for s in sets:
        df = frequency[at : at + len(s)]
        at += len(s)
        sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
        prefix = prefix_length(len(s))
        if not len(s) or int((df == 1).sum()) >= prefix:
            cost.append(0)
            tokens.append(None)
            keys.append(None)
            continue
        first = np.lexsort((s, df))[:prefix]
        first = first[df[first] > 1]
        cost.append(int(df[first].sum()))
        tokens.append(s.view(np.int64))
        keys.append(s[first].view(np.int64))
    longs = pa.list_(pa.int64())
    return pa.table(
        {
            "doc_id": rows["doc_id"], "n": pa.array([len(s) for s in sets], pa.int32()), "sig": pa.array(sig, pa.binary()),
            "scan_cost": pa.array(cost, pa.int64()), "tokens": pa.array(tokens, longs), "keys": pa.array(keys, longs),
        }
    )


def boundary(sets: DataFrame, most: int = SMALL_MOST) -> int:
    """The size up to which enumerating subsets is the cheaper way for the sets that are there; 0 if none."""
    rows = sets.where(F.col("tokens").isNotNull() & (F.col("n") <= most)).groupBy("n").agg(F.count("*").alias("sets"), F.sum("scan_cost").alias("scan")).collect()
    best = saved = here = 0
    for r in sorted(rows, key=lambda r: r["n"]):
        saved += r["scan"] - r["sets"] * subset_count(r["n"])
        if saved > best:
            best, here = saved, r["n"]
    return here


def set_keys(tokens: np.ndarray, prefix: np.ndarray, small: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys under which a set meets all that it may link with; and their positions in the common order of the set's
    shingles, -1 for subsets. `prefix`: the last of the set's first prefix_length() shingles (those before are its own)."""
    n = len(tokens)
    out, at = [np.zeros(0, U)], [np.zeros(0, np.int32)]
    if n <= small:
        for b in partner_sizes(n):
            if b <= small and b:
                c, sizes = overlap_needed(n, b), U(min(n, b) * 1000 + max(n, b))
                subsets = np.array(list(combinations(tokens.tolist(), c)), dtype=U).reshape(-1, c)
                h = np.full(len(subsets), sizes)
                for i in range(c):
                    h = fmix(h * U(0x9E3779B97F4A7C15) + subsets[:, i])
                out.append(np.unique(h))
                at.append(np.full(len(out[-1]), -1, np.int32))
    if partner_sizes(n)[-1] > small:
        out.append(prefix)
        at.append(np.arange(prefix_length(n) - len(prefix), prefix_length(n), dtype=np.int32))
    return np.concatenate(out), np.concatenate(at)


def entries(sets: DataFrame, small: int) -> DataFrame:
    """(key, doc_id, n, at): the inverted lists, one row per set and key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, prefixes = ([np.asarray(x.values, dtype=np.int64).view(U) for x in batch.column(i)] for i in (1, 2))
            for i in range(0, batch.num_rows, 500):
                found = [set_keys(t, p, small) for t, p in zip(tokens[i : i + 500], prefixes[i : i + 500])]
                rows = np.repeat(np.arange(i, i + len(found)), [len(k) for k, _ in found])
                columns = [pa.array(np.concatenate([k for k, _ in found]).view(np.int64)), *(batch.column(c).take(pa.array(rows)) for c in (0, 3)), pa.array(np.concatenate([p for _, p in found]))]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "doc_id", "n", "at"])

    return sets.select("doc_id", "tokens", "keys", "n").mapInArrow(run, "key long, doc_id long, n int, at int")


def open_keys(lists: DataFrame) -> DataFrame:
    """(key) of the lists whose documents are in two components or more."""
    return lists.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("key")


def leaders(lists: DataFrame, most: int) -> DataFrame:
    """The first `most` documents of each list (Spark cuts each list down to them before it shuffles), and the last of
    them as `upto`."""
    ranked = lists.withColumn("place", F.rank().over(Window.partitionBy("key").orderBy("doc_id"))).where(F.col("place") <= most)
    upto = F.max("doc_id").over(Window.partitionBy("key"))
    return ranked.select("key", F.col("doc_id").alias("leader"), F.col("n").alias("l_n"), F.col("at").alias("l_at"), F.col("component").alias("l_component"), upto.alias("upto"))


def pairs_to_verify(lists: DataFrame, first: DataFrame) -> DataFrame:
    """(leader, doc_id, l_component, component): pairs of a leader and a later document of its list, not joined yet, that
    may link: by their sizes, and by what is left of both from their first common shingle on."""
    need = F.ceil(NUMERATOR * (F.col("n") + F.col("l_n")) / (NUMERATOR + DENOMINATOR))
    left = 1 + F.least(F.col("n") - F.col("at") - 1, F.col("l_n") - F.col("l_at") - 1)
    fits = (F.least("n", "l_n") >= need) & ((F.col("at") < 0) | (left >= need))
    apart = (F.col("doc_id") > F.col("leader")) & (F.col("component") != F.col("l_component"))
    return lists.join(first, "key").where(apart & fits).select("leader", "doc_id", "l_component", "component").distinct()


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): the components of the pairs that link, by the size of their sets' intersection."""
    mine = sets.select("doc_id", "n", "tokens")
    led = sets.select(F.col("doc_id").alias("leader"), F.col("n").alias("l_n"), F.col("tokens").alias("l_tokens"))
    shared = F.size(F.array_intersect("tokens", "l_tokens"))
    both = pairs.join(mine, "doc_id").join(led, "leader").select(F.col("l_component").alias("a"), F.col("component").alias("b"), (F.col("n") + F.col("l_n")).alias("sizes"), shared.alias("shared"))
    return both.where(DENOMINATOR * F.col("shared") >= NUMERATOR * (F.col("sizes") - F.col("shared"))).select("a", "b").distinct()


def joined(groups: DataFrame | None, merged: DataFrame) -> DataFrame:
    """(node, component) after the components of `groups` are joined as `merged` (node, component) says."""
    if groups is None:
        return merged
    new = groups.join(merged.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
    alone = merged.join(groups.select("node"), "node", "left_anti")
    return durable(new.select("node", F.coalesce("into", "component").alias("component")).union(alone.select("node", "component")), "groups")


def components(sets: DataFrame, small: int) -> DataFrame | None:
    """(node, component) of all documents with links, from verified links; None if there are none.

    What is joined by key is written before, so that adaptive execution can split the rows of a long list.
    """
    rest, groups, most = durable(entries(sets, small).withColumn("component", F.col("doc_id")), "lists"), None, 1
    while (keys := durable(open_keys(rest), "keys")).limit(1).collect():
        lists = rest.join(keys, "key", "left_semi")
        first = durable(leaders(lists, most), "leaders")
        links = durable(verified(pairs_to_verify(lists, first), sets), "links")
        ends = first.where("leader = upto").select(F.col("key").alias("e_key"), "upto")
        later = lists.join(ends, (F.col("key") == F.col("e_key")) & (F.col("doc_id") > F.col("upto")), "left_semi")
        if links.limit(1).collect():
            merged = durable(connected_components(links), "merged")
            groups = joined(groups, merged)
            later = later.join(merged.select(F.col("node").alias("component"), F.col("component").alias("into")), "component", "left")
            later = later.withColumn("component", F.coalesce("into", "component"))
        last, rest = rest, durable(later.select("key", "doc_id", "n", "at", "component"), "lists")
        forget(last, first, keys)
        most *= GROWTH
    return groups


def join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links)."""
    sets = durable(count_keys(docs.select("doc_id", "text"), lambda texts: np.concatenate(sets_of(texts) or [np.zeros(0, U)]), _sets, SETS, width=4), "sets")
    # written, so that adaptive execution can split the rows of a large group of equal sets
    classes = sets.where("n > 0").groupBy("n", "sig").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")).where("size > 1").drop("size")
    classes = durable(classes, "classes")
    rep = F.coalesce("rep", F.when(F.col("n") > 0, F.col("doc_id")))
    members = durable(sets.select("doc_id", "n", "sig").join(classes, ["n", "sig"], "left").withColumn("rep", rep), "members")
    copies = members.where("doc_id <> rep").select("doc_id", "n", "sig")
    reps = sets.where(F.col("tokens").isNotNull() & F.col("doc_id").isNotNull()).join(copies, ["doc_id", "n", "sig"], "left_anti")
    # sets that share a doc_id stay apart here, but are one node
    reps = durable(reps.dropDuplicates(["doc_id", "n", "sig"]), "representatives")
    forget(sets, classes)
    groups = components(reps, boundary(reps))
    forget(reps)
    if groups is None:
        groups = docs.sparkSession.createDataFrame([], "node long, component long")
    out = members.join(groups.where("node <> component"), F.col("rep") == F.col("node"), "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "rep", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """`docs` with one row of each group of linked texts: of ids that one row has, that with the smallest; in groups
    without any, one of the rows that repeat an id or have none. Such rows count as documents of their own here, under
    numbers beyond all ids; they alone are written for that."""
    names = docs.columns
    node = free_name("node", names)
    again = durable(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").select("doc_id"), "repeated-ids")
    once, odd = docs.withColumn(node, F.col("doc_id").cast("long")), None
    if again.limit(1).collect():
        most = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).cast("long")).collect()[0][0]
        ids = again.withColumnRenamed("doc_id", "again_id")
        once = once.where(F.col("doc_id").isNotNull()).join(again.where("doc_id is not null"), "doc_id", "left_anti").select(*names, node)
        odd = docs.join(ids.where("again_id is not null"), F.col("doc_id") == F.col("again_id"), "left_semi").union(docs.where(F.col("doc_id").isNull()))
        odd = durable(odd.withColumn(node, F.greatest(F.lit(most), F.lit(0)) + 1 + F.monotonically_increasing_id()), "repeats")
    whole = once if odd is None else once.union(odd)
    linked = join(whole.select(F.col(node).alias("doc_id"), "text"))
    gone = durable(linked.where("doc_id <> component_id").select(F.col("doc_id").alias(node)), "duplicates")
    return whole.join(gone, node, "left_anti").select(*names)
