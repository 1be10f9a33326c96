"""Graph reasoning: entity vectors refined by messages along facts, scored by cosine.

Vectors are arrays of doubles, derived from md5 of the name where none are given.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factline.session import durable

DIMENSIONS = 16


def name_vector(name: Column, dimensions: int = DIMENSIONS) -> Column:
    """A unit vector fixed by the name."""
    part = lambda i: F.conv(F.substring(F.md5(F.concat(name, F.lit(":"), i.cast("string"))), 1, 6), 16, 10).cast("double") / 8388608.0 - 1
    return unit(F.transform(F.sequence(F.lit(1), F.lit(dimensions)), part))


def unit(v: Column) -> Column:
    """v with norm 1, or zeros. The norm is bound in a struct first: inside the inner function it would be computed
    again for each element."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    scale = lambda p: F.transform(p["v"], lambda x: F.when(p["n"] > 0, x / p["n"]).otherwise(0.0))
    return F.get(F.transform(F.array(F.struct(v.alias("v"), norm.alias("n"))), scale), F.lit(0))


def entity_vectors(facts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    names = facts.select(F.col("subject").alias("name")).union(facts.select("object")).distinct()
    return names.select("name", name_vector(F.col("name"), dimensions).alias("vector"))


def message_layer(facts: DataFrame, entities: DataFrame, dimensions: int = DIMENSIONS, keep: float = 0.5) -> DataFrame:
    """Each entity's vector mixed with the mean of (subject + relation) over the facts that lead to it.

    Facts are counted per (subject, relation, object) before vectors are joined; sums per dimension are aggregated
    before they are gathered again, so a hub's facts are added up where they are. Vectors are written before they are
    used twice, those of relations once a relation.
    """
    entities = durable(entities, "vectors")
    relations = durable(facts.select("relation").distinct().select("relation", name_vector(F.col("relation"), dimensions).alias("r")), "relations")
    by = facts.groupBy("subject", "relation", "object").agg(F.count("*").alias("n"))
    sent = by.join(entities.withColumnRenamed("name", "subject"), "subject")
    sums = [F.sum(F.col("n") * (F.get("vector", F.lit(i)) + F.get("r", F.lit(i)))).alias(f"d{i}") for i in range(dimensions)]
    got = sent.join(relations, "relation").groupBy(F.col("object").alias("name")).agg(*sums)
    mean = unit(F.array(*[f"d{i}" for i in range(dimensions)]))
    both = entities.join(got.select("name", mean.alias("mean")), "name", "left")
    mixed = unit(F.zip_with("vector", "mean", lambda a, b: keep * a + (1 - keep) * b))
    return both.select("name", F.when(F.col("mean").isNull(), F.col("vector")).otherwise(mixed).alias("vector"))


BLOCK = 4_096  # questions of a part, at least
QUESTIONS, ENTITIES = 16 * BLOCK, 64 * BLOCK  # rows that a task holds, on average
ROWS, COLUMNS = 512, 2_048  # of a matrix of scores
SLACK = 1e-5  # by how much single precision may be wrong


def _unit_rows(column: pa.ChunkedArray) -> np.ndarray:
    v = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
    norm = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)


def alike(q: np.ndarray, size: int) -> list[np.ndarray]:
    """The rows of q in blocks of at most `size` that lie close together: halves along the direction in which they differ most."""
    parts, out = [np.arange(len(q))], []
    while parts:
        at = parts.pop()
        if len(at) <= size:
            out.append(at)
            continue
        x = q[at] - q[at].mean(axis=0)
        cut = -(-len(at) // size) // 2 * size
        order = np.argpartition(x @ np.linalg.eigh(x.T @ x)[1][:, -1], cut)
        parts += [at[order[:cut]], at[order[cut:]]]
    return out


def best_pairs(q: np.ndarray, e: np.ndarray, own: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of e, score): for each row of q the `top` rows of e of largest positive product, without row `own`
    (-1: none); ties by the row of e. e: rows of norm 1, or 0.

    Products are taken in single precision first. The top-th best score of the rows of e seen so far is a bound that no
    answer lies below, so what is below it, less SLACK, goes, and only the others are computed exactly and ordered.

    Rows of q are taken in blocks of alike ones. The angle between a row of q and one of e is at least the difference of their angles to
    the block's middle; so the rows of e closest to it give a first bound, and rows that are too far from the middle for it are
    not multiplied with the block. Where rows of q point everywhere, that leaves all of e.
    """
    q32, e32 = q.astype(np.float32), np.ascontiguousarray(e.T, dtype=np.float32)
    size = np.sqrt((q * q).sum(axis=1))
    out: tuple[list, list, list] = ([], [], [])
    scores, above = np.empty((ROWS, COLUMNS), np.float32), np.empty((ROWS, COLUMNS), bool)
    for at in alike(q, ROWS):
        at = at[size[at] > 0]  # the others have no positive product
        n = len(at)
        if not n:
            continue
        mine, mine32, skip = q[at], q32[at], own[at]
        middle = (mine / size[at, None]).mean(axis=0)
        middle /= max(np.sqrt((middle * middle).sum()), 1e-300)
        close = middle.astype(np.float32) @ e32
        k = min(COLUMNS, len(e))
        least = np.zeros((n, 1), np.float32)
        if k > top:  # one more than `top`, as `own` may be among them
            first = np.argpartition(close, len(e) - k)[len(e) - k :]
            least = np.maximum(np.partition(mine32 @ e32[:, first], k - top - 1, axis=1)[:, k - top - 1, None], 0)
        angle = lambda x: np.arccos(np.clip(x / size[at], -1, 1))
        within = np.flatnonzero(close >= np.cos(np.minimum(np.pi, angle(mine @ middle) + angle(least[:, 0] - SLACK))).min() - SLACK)
        near = e32 if len(within) == len(e) else np.take(e32, within, axis=1)
        place = np.minimum(np.searchsorted(within, skip), max(0, len(within) - 1))
        skip = np.where(within[place] == skip, place, -1) if len(within) else np.full(n, -1)
        row, column, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        fresh: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0
        for b in range(0, len(within), COLUMNS):
            m = min(COLUMNS, len(within) - b)
            s, over = scores[:n, :m], above[:n, :m]
            np.matmul(mine32, near[:, b : b + m], out=s)
            here = np.flatnonzero((skip >= b) & (skip < b + m))
            s[here, skip[here] - b] = -1
            np.greater(s, least - np.float32(SLACK), out=over)
            r, c = np.divmod(np.flatnonzero(over), m)
            fresh.append((r, c + b))
            waiting += len(r)
            if waiting > 4 * top * n or b + m >= len(within):
                r, c = (np.concatenate(x) for x in zip(*fresh))
                r, c = r[c != skip[r]], c[c != skip[r]]
                row, column, score = np.append(row, r), np.append(column, c), np.append(score, (mine[r] * e[within[c]]).sum(axis=1))
                keep = np.lexsort((column, -score, row))
                keep = keep[score[keep] > 0]
                place = np.arange(len(keep)) - np.searchsorted(row[keep], row[keep])
                keep = keep[place < top]
                row, column, score = row[keep], column[keep], score[keep]
                full = np.bincount(row, minlength=n) == top
                last = np.searchsorted(row, np.arange(n), side="right") - 1
                least[full, 0] = np.maximum(least[full, 0], score[last[full]])
                fresh, waiting = [], 0
        for x, y in zip(out, (at[row], within[column], score)):
            x.append(y)
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in zip(out, (np.int64, np.int64, np.float64)))


def top_by_cosine(asked: DataFrame, entities: DataFrame, top: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """(asked_id, `keep`, entity, score): for each row of `asked` (asked_id, subject, q) the `top` entities of positive
    cosine with q, without the subject; ties by name. keep: columns of `asked` that go with its answers.

    Every question is scored against every entity. Parts of questions meet parts of entities in the cells of a grid, one
    task a cell, which leaves `top` rows a question. Parts are as large as a task may hold, so that entities are copied
    to few cells (two for each core, as long as these hold the questions), and up to ENTITIES of them a question has one cell, and nothing is shuffled after it.
    Each cell has a partition of its own.
    """
    from pyspark.sql import Window

    parts = lambda rows, size: max(1, -(-rows // size))
    rows, tasks = asked.count(), 2 * asked.sparkSession.sparkContext.defaultParallelism
    n = parts(entities.count(), ENTITIES)
    m = max(parts(rows, QUESTIONS), min(parts(rows, BLOCK), parts(tasks, n)))
    part = lambda key, k: F.pmod(F.xxhash64(key), F.lit(k))
    cells = lambda k, cell: F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: cell(i).cast("int"))).alias("cell")
    grid = lambda df: df.repartitionById(m * n, F.col("cell")).groupBy("cell")

    def run(q: pa.Table, e: pa.Table) -> pa.Table:
        e = e.sort_by("name")
        own = pc.fill_null(pc.index_in(q["subject"], e["name"]), -1).to_numpy()
        row, column, score = best_pairs(_unit_rows(q["q"]), _unit_rows(e["vector"]), own, top) if len(q) and len(e) else ([], [], [])
        at = lambda c, i: c.combine_chunks().take(pa.array(i, pa.int64()))
        return pa.table({**{c: at(q[c], row) for c in ("asked_id", *keep)}, "entity": at(e["name"], column), "score": pa.array(score, pa.float64())})

    q = grid(asked.select(cells(n, lambda i: part("asked_id", m) * n + i), *{"asked_id": 0, "subject": 0, "q": 0, **dict.fromkeys(keep)}))
    kinds = "".join(f"{c} {asked.schema[c].dataType.simpleString()}, " for c in ("asked_id", *keep))
    scored = q.cogroup(grid(entities.select(cells(m, lambda i: i * n + part("name", n)), "name", "vector"))).applyInArrow(run, f"{kinds}entity string, score double")
    if n == 1:
        return scored
    rank = F.row_number().over(Window.partitionBy("asked_id").orderBy(F.desc("score"), "entity"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= top).drop("rank")


def graph_scores(entities: DataFrame, queries: DataFrame, top: int = 20, dimensions: int = DIMENSIONS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, `keep`, entity, score): entities by cosine with subject + relation, positive, without the subject; the
    `top` of each question. Equal (subject, relation) questions are scored once; unknown subjects have no candidates.
    keep: columns of `queries` that go with its answers."""
    vectors = entities.select(F.col("name").alias("subject"), F.col("vector").alias("s"))
    asked = queries.select("subject", "relation").distinct().join(vectors, "subject").withColumn("asked_id", F.xxhash64("subject", "relation"))
    asked = asked.select("asked_id", "subject", F.zip_with("s", name_vector(F.col("relation"), dimensions), lambda a, b: a + b).alias("q"))
    entities, asked = durable(entities, "vectors"), durable(asked, "asked")
    return queries.select("query_id", *keep, F.xxhash64("subject", "relation").alias("asked_id")).join(top_by_cosine(asked, entities, top), "asked_id").drop("asked_id")
