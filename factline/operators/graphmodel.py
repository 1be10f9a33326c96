"""A trained graph side: entity vectors refined by time-aware messages, questions encoded with their relation and time.

A layer mixes each entity with the mean message of the facts that lead to it; a message is linear in the vectors of
subject, relation and object and in the time. As means and linear maps commute, Spark sums vectors per object with
partial aggregation and joins them once, and the small weight matrices are applied to batches of entities. A question
is encoded by two linear maps of (subject, relation, time) and scored by cosine against all entities in blocks.

Training goes in rounds, one an epoch (local steps with averaging, McMahan et al., 2017): facts are dealt to batches anew
in each, a task takes an Adam step on the margin loss of each of its batches, one after the other, on its own copy of the
weights and of the vectors that occur in them, and the changes of all tasks are averaged per entity, relation and weight.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.operators import embed
from factline.operators.lookup import vocabulary
from factline.operators.paths import draw
from factline.session import durable, forget

YEAR = 365.0
EPS = 1e-5
VECTOR = "array<double>"


def first_weights(dimensions: int, layers: int, seed: int) -> dict[str, np.ndarray]:
    """Weights of `layers` layers and of the question's encoder."""
    rng, d = np.random.default_rng(seed), dimensions
    linear = lambda a, b: rng.uniform(-1, 1, (a, b)) * np.sqrt(6 / (a + b))
    w: dict[str, np.ndarray] = {}
    for k in range(layers):
        w |= {f"{k}.head": linear(d, d), f"{k}.relation": linear(d, d), f"{k}.tail": linear(d, d), f"{k}.bias": np.zeros(d), f"{k}.time": rng.uniform(-1, 1, d)}
        w |= {f"{k}.own": linear(d, d), f"{k}.got": linear(d, d), f"{k}.add": np.zeros(d), f"{k}.gain": np.ones(d), f"{k}.shift": np.zeros(d)}
    w |= {"q.in": linear(2 * d, 3 * d), "q.in_bias": np.zeros(2 * d), "q.out": linear(d, 2 * d), "q.out_bias": np.zeros(d), "q.time": rng.uniform(-1, 1, d), "q.time_bias": np.zeros(d)}
    return w


@dataclass(frozen=True)
class Model:
    """weights; entities and relations: (name, vector); origin: the day that counts as time 0."""

    weights: dict[str, np.ndarray]
    entities: DataFrame
    relations: DataFrame
    origin: int
    layers: int
    steps: int = 0
    moments: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)


def start(facts: DataFrame, dimensions: int = embed.DIMENSIONS, layers: int = 2, seed: int = 42) -> Model:
    """An untrained model: vectors that the names fix, weights that the seed fixes."""
    relations = facts.select(F.col("relation").alias("name")).distinct()
    relations = relations.select("name", embed.name_vector(F.concat(F.lit("relation:"), "name"), dimensions).alias("vector"))
    origin = facts.agg(F.min("day")).collect()[0][0] or 0
    return Model(first_weights(dimensions, layers, seed), embed.entity_vectors(facts, dimensions), relations, origin, layers)


def mixed(w: dict[str, np.ndarray], k: int, own: np.ndarray, head: np.ndarray, relation: np.ndarray, time: np.ndarray) -> tuple[np.ndarray, ...]:
    """Layer k for rows of entities with means of head and relation vectors and of times: (vectors, message, normalised
    sum before gain, its deviation)."""
    message = head @ w[f"{k}.head"].T + relation @ w[f"{k}.relation"].T + own @ w[f"{k}.tail"].T + w[f"{k}.bias"] + time[:, None] * w[f"{k}.time"]
    z = own + own @ w[f"{k}.own"].T + message @ w[f"{k}.got"].T + w[f"{k}.add"]
    deviation = np.sqrt(z.var(axis=1, keepdims=True) + EPS)
    normal = (z - z.mean(axis=1, keepdims=True)) / deviation
    return normal * w[f"{k}.gain"] + w[f"{k}.shift"], message, normal, deviation


def encoded(w: dict[str, np.ndarray], subject: np.ndarray, relation: np.ndarray, time: np.ndarray) -> tuple[np.ndarray, ...]:
    """Question vectors; and their input and the first map's output."""
    x = np.concatenate([subject, relation, time[:, None] * w["q.time"] + w["q.time_bias"]], axis=1)
    u = x @ w["q.in"].T + w["q.in_bias"]
    return np.maximum(u, 0) @ w["q.out"].T + w["q.out_bias"], x, u


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _lists(m: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(m.reshape(-1)))


def _sums(vector: str, dimensions: int, name: str, by: str | Column = "n") -> list[Column]:
    n = F.col(by) if isinstance(by, str) else by
    return [F.sum(n * F.get(vector, F.lit(i))).alias(f"{name}{i}") for i in range(dimensions)]


def _gathered(name: str, dimensions: int, by: str) -> Column:
    return F.array(*[F.col(f"{name}{i}") / F.col(by) for i in range(dimensions)]).alias(name)


def propagate(facts: DataFrame, model: Model) -> DataFrame:
    """(name, vector) of all entities after the layers over `facts`; entities to which no fact leads keep their own.

    Facts are counted per (subject, relation, object), vectors are joined to these counts, and a hub's messages are added
    up where they are.
    """
    d = len(model.weights["0.bias"]) if model.layers else 0
    by = facts.groupBy("subject", "relation", "object").agg(F.count("*").alias("n"), F.sum("day").alias("days"))
    by = durable(by, "edges") if model.layers > 1 else by
    entities = model.entities.select("name", "vector")
    held = facts.sparkSession.sparkContext.broadcast(model.weights)  # a few matrices of `dimensions` squared
    origin = model.origin
    for k in range(model.layers):
        sent = by.join(entities.select(F.col("name").alias("subject"), F.col("vector").alias("h")), "subject").join(model.relations.select(F.col("name").alias("relation"), F.col("vector").alias("r")), "relation")
        got = sent.groupBy(F.col("object").alias("name")).agg(F.sum("n").alias("n"), F.sum("days").alias("days"), *_sums("h", d, "h"), *_sums("r", d, "r"))
        got = got.select("name", _gathered("h", d, "n"), _gathered("r", d, "n"), ((F.col("days") / F.col("n") - origin) / YEAR).alias("time"))

        def run(batches, k=k):
            for batch in batches:
                new = mixed(held.value, k, *(_matrix(batch.column(i)) for i in (1, 2, 3)), batch.column(4).to_numpy())[0] if batch.num_rows else np.zeros((0, d))
                yield pa.RecordBatch.from_arrays([batch.column(0), _lists(new)], names=["name", "new"])

        new = entities.join(got, "name").select("name", "vector", "h", "r", "time").mapInArrow(run, f"name string, new {VECTOR}")
        entities = durable(entities.join(new, "name", "left").select("name", F.coalesce("new", "vector").alias("vector")), "layer")
    return entities


def questions(model: Model, entities: DataFrame, queries: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(asked_id, subject, q, `keep`): encoded queries (query_id, subject, relation, day) with known subject and relation."""
    held, origin = queries.sparkSession.sparkContext.broadcast(model.weights), model.origin
    known = queries.join(entities.select(F.col("name").alias("subject"), F.col("vector").alias("s")), "subject").join(model.relations.select(F.col("name").alias("relation"), F.col("vector").alias("r")), "relation")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                time = (batch.column(4).to_numpy() - origin) / YEAR
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _lists(encoded(held.value, _matrix(batch.column(2)), _matrix(batch.column(3)), time)[0]), *batch.columns[5:]], names=["asked_id", "subject", "q", *more])

    more = [c for c in keep if c != "subject"]
    kinds = "".join(f", {c} {queries.schema[c].dataType.simpleString()}" for c in more)
    return known.select(F.col("query_id").alias("asked_id"), "subject", "s", "r", F.col("day").cast("double").alias("at"), *more).mapInArrow(run, f"asked_id long, subject string, q {VECTOR}{kinds}")


def graph_scores(facts: DataFrame, model: Model, queries: DataFrame, top: int = 20, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, `keep`, entity, score): for each query the `top` entities of positive cosine with the encoded question,
    without its subject. facts: the history, all of it before the queries. keep: columns of `queries` that go with it."""
    entities = propagate(facts, model)
    asked = durable(questions(model, entities, queries, keep), "asked")
    return embed.top_by_cosine(asked, entities, top, keep).withColumnRenamed("asked_id", "query_id")


# --- training ----------------------------------------------------------------------------------------------------------


def batch_gradient(w: dict[str, np.ndarray], layers: int, h: np.ndarray, e: np.ndarray, facts: np.ndarray, time: np.ndarray, others: np.ndarray, margin: float, mask: np.ndarray | float = 1.0) -> tuple[float, dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Loss and its gradients by weights, entity vectors h and relation vectors e, for one batch in time order.

    facts: (subject, relation, object) indices; others: drawn entities per fact. The earlier half of the facts are
    messages, the later half questions: max(0, margin - score of the object + score of the other), on average. mask: what
    the encoder's inner values are multiplied by (dropout).
    """
    half = (len(facts) + 1) // 2
    s, r, o = facts[:half].T
    to, o = np.unique(o, return_inverse=True)  # only these change in a layer
    per = np.bincount(o).astype(float)[:, None]

    def spread(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(to), values.shape[1]))
        np.add.at(out, o, values)
        return out / per

    at, kept = spread(time[:half, None])[:, 0], []
    for k in range(layers):
        own, head, rel = h[to], spread(h[s]), spread(e[r])
        new, message, normal, deviation = mixed(w, k, own, head, rel, at)
        kept.append((own, head, rel, message, normal, deviation))
        h = h.copy()
        h[to] = new
    qs, qr, qo = facts[half:].T
    _, x, u = encoded(w, h[qs], e[qr], time[half:])
    inner = np.maximum(u, 0) * mask
    q = inner @ w["q.out"].T + w["q.out_bias"]
    length = lambda m: np.sqrt((m * m).sum(axis=1, keepdims=True)) + 1e-12
    qn, hn, ql, hl = q / length(q), h / length(h), length(q), length(h)
    pos = (qn * hn[qo]).sum(axis=1)
    neg = np.einsum("kd,kjd->kj", qn, hn[others[half:]])
    differs = others[half:] != qo[:, None]
    miss = np.where(differs, margin - pos[:, None] + neg, 0)
    active = (miss > 0) / np.maximum(1, differs.sum(axis=1, keepdims=True)) / max(1, len(qo))
    loss = float((np.maximum(miss, 0) * (active > 0) / np.maximum(1, differs.sum(axis=1, keepdims=True))).sum() / max(1, len(qo)))
    d_pos = -active.sum(axis=1, keepdims=True)
    d_qn = d_pos * hn[qo] + np.einsum("kj,kjd->kd", active, hn[others[half:]])
    d_hn = np.zeros_like(h)
    np.add.at(d_hn, qo, d_pos * qn)
    np.add.at(d_hn, others[half:].reshape(-1), (active[:, :, None] * qn[:, None, :]).reshape(-1, h.shape[1]))
    back = lambda g, unit, size: (g - unit * (g * unit).sum(axis=1, keepdims=True)) / size
    d_h, d_q, d_e, g = back(d_hn, hn, hl), back(d_qn, qn, ql), np.zeros_like(e), {}
    g["q.out"], g["q.out_bias"] = d_q.T @ inner, d_q.sum(axis=0)
    d_u = (d_q @ w["q.out"]) * (u > 0) * mask
    g["q.in"], g["q.in_bias"] = d_u.T @ x, d_u.sum(axis=0)
    d_s, d_r, d_t = np.split(d_u @ w["q.in"], 3, axis=1)
    g["q.time"], g["q.time_bias"] = (d_t * time[half:, None]).sum(axis=0), d_t.sum(axis=0)
    np.add.at(d_h, qs, d_s)
    np.add.at(d_e, qr, d_r)
    for k in reversed(range(layers)):
        own, head, rel, message, normal, deviation = kept[k]
        d_new = d_h[to]
        g[f"{k}.gain"], g[f"{k}.shift"] = (d_new * normal).sum(axis=0), d_new.sum(axis=0)
        d_n = d_new * w[f"{k}.gain"]
        d_z = (d_n - d_n.mean(axis=1, keepdims=True) - normal * (d_n * normal).mean(axis=1, keepdims=True)) / deviation
        g[f"{k}.own"], g[f"{k}.got"], g[f"{k}.add"] = d_z.T @ own, d_z.T @ message, d_z.sum(axis=0)
        d_m = d_z @ w[f"{k}.got"]
        g[f"{k}.head"], g[f"{k}.relation"], g[f"{k}.tail"], g[f"{k}.bias"] = d_m.T @ head, d_m.T @ rel, d_m.T @ own, d_m.sum(axis=0)
        g[f"{k}.time"] = (d_m * at[:, None]).sum(axis=0)
        d_h[to] = d_z + d_z @ w[f"{k}.own"] + d_m @ w[f"{k}.tail"]
        np.add.at(d_h, s, (d_m @ w[f"{k}.head"] / per)[o])
        np.add.at(d_e, r, (d_m @ w[f"{k}.relation"] / per)[o])
    return loss, g, d_h, d_e


PER_TASK = 32  # batches on which a task steps in a round
PER_PART = 524_288  # facts of a part, about; its tasks share one copy of the vectors that occur in it


def keyed(facts: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(row_id, day, s, r, o), facts by ids; (kind, name, id) of entities, whose ids are those of vocabulary(), and of
    relations, -1, -2 and so on; and the number of entities."""
    entities, relations = vocabulary(facts, "subject", "object"), vocabulary(facts, "relation")
    names = entities.select(F.lit("entity").alias("kind"), F.col("value").alias("name"), F.col("id").cast("long").alias("id"))
    names = durable(names.union(relations.select(F.lit("relation"), "value", (-1 - F.col("id")).cast("long"))), "names")
    key = lambda kind, name, id_: names.where(F.col("kind") == kind).select(F.col("name").alias(name), F.col("id").alias(id_))
    rows = facts.select("row_id", "day", "subject", "relation", "object")
    for kind, name in (("entity", "subject"), ("relation", "relation"), ("entity", "object")):
        rows = rows.join(key(kind, name, name[0]), name).drop(name)
    return durable(rows, "keyed"), names, names.where("kind = 'entity'").count()


def layout(rows: DataFrame, batch: int) -> tuple[int, int, int, int]:
    """Numbers of facts, batches, tasks and parts. Parts are few, as each gets a copy of what occurs in it: two for each core,
    more from PER_PART facts."""
    n = rows.count()
    count = max(1, n // batch)
    tasks = -(-count // PER_TASK)
    return n, count, tasks, min(tasks, max(-(-n // PER_PART), 2 * rows.sparkSession.sparkContext.defaultParallelism))


def dealt(rows: DataFrame, total: int, batch: int, negatives: int, seed: int) -> DataFrame:
    """Rows of keyed() with their batch, the task of PER_TASK batches, the part of whole tasks, and the array `others` of
    drawn entities. A part has a partition of its own, so that none waits for two."""
    _, count, tasks, parts = layout(rows, batch)
    number = lambda i: F.conv(F.substring(draw(seed, "row_id", F.lit(i)), 1, 12), 16, 10).cast("long") % total
    rows = rows.withColumn("batch", F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(count))).withColumn("task", F.floor(F.col("batch") / PER_TASK))
    rows = rows.withColumn("part", F.floor(F.col("task") * parts / tasks).cast("int")).repartitionById(parts, F.col("part"))
    return rows.withColumn("others", F.array(*[number(i) for i in range(1, negatives + 1)]))


def _batches(facts: DataFrame, model: Model, batch: int, negatives: int, seed: int) -> DataFrame:
    """What train() deals in a round, by names, to look at: facts with their batch, task and `others` (i, name)."""
    rows, names, total = keyed(facts)
    rows = dealt(rows, total, batch, negatives, seed)
    drawn = rows.select("row_id", F.posexplode("others").alias("i", "id")).join(names, "id").groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("i", "name"))).alias("others"))
    return rows.select("row_id", "batch", "task").join(facts.select("row_id", "subject", "relation", "object", "day"), "row_id").join(drawn, "row_id")


CACHED = 512  # rows that are moved at once, so that they stay in the processor's cache


class Adam:
    """Adam with weight decay over named arrays, which it changes in place; moments may be given."""

    def __init__(self, rate: float, decay: float, moments: dict[str, tuple[np.ndarray, np.ndarray]] | None = None, steps: int = 0):
        self.rate, self.decay, self.steps = rate, decay, steps
        self.moments = {k: (m.copy(), v.copy()) for k, (m, v) in (moments or {}).items()}

    def step(self, values: dict[str, np.ndarray], slopes: dict[str, np.ndarray]) -> None:
        self.steps += 1
        for k, x in values.items():
            m, v = self.moments.setdefault(k, (np.zeros_like(x), np.zeros_like(x)))
            g = self.decay * x
            g += slopes[k]
            m *= 0.9
            m += 0.1 * g
            g *= g
            v *= 0.999
            g *= 0.001
            v += g
            root = np.sqrt(v / (1 - 0.999**self.steps))
            root += 1e-8
            np.divide(m, root, out=root)
            root *= self.rate / (1 - 0.9**self.steps)
            x -= root


class Vectors:
    """Rows of x, which it changes in place, under Adam with weight decay from no moments on, where most steps bring slopes for few rows.

    A row's steps without slopes depend on nothing but the row. They are taken when it is looked at, by blocks of rows that
    stay in the processor's cache, not by all rows in each step. Moments are held over 0.9 and 0.999 to the power of the
    step, so that what fades need not be multiplied; a task has few steps.
    """

    def __init__(self, x: np.ndarray, rate: float, decay: float):
        self.x, self.m, self.v, self.done = x, np.zeros_like(x), np.zeros_like(x), np.zeros(len(x), np.int64)
        self.rate, self.decay, self.held = rate, decay, None

    def at(self, rows: np.ndarray, steps: int) -> np.ndarray:
        """These rows (each once) after `steps` steps, the ones not yet taken being without slopes."""
        order = np.argsort(self.done[rows], kind="stable")  # those furthest behind come first
        late = rows[order]
        done, held = self.done[late], (self.x[late], self.m[late], self.v[late])
        for i in range(0, len(late), CACHED):
            x, m, v = (y[i : i + CACHED] for y in held)
            for step in range(done[i] + 1, steps + 1):
                n = np.searchsorted(done[i : i + CACHED], step)
                self._move(x[:n], m[:n], v[:n], step)
        self.held = late, held, order, steps
        out = np.empty_like(held[0])
        out[order] = held[0]
        return out

    def step(self, slopes: np.ndarray) -> None:
        """The next step of the rows that at() has returned last; no other rows are kept as at() brings them."""
        late, held, order, steps = self.held
        slopes = slopes[order]
        for i in range(0, len(late), CACHED):
            self._move(*(y[i : i + CACHED] for y in held), steps + 1, slopes[i : i + CACHED])
        self.x[late], self.m[late], self.v[late] = held
        self.done[late] = steps + 1

    def _move(self, x: np.ndarray, m: np.ndarray, v: np.ndarray, step: int, slopes: np.ndarray | None = None) -> None:
        a, b = 0.9**step, 0.999**step
        c = np.sqrt(b / (1 - b))
        if slopes is None:
            t = x * (0.1 * self.decay / a)
        else:
            t = x * self.decay
            t += slopes
            t *= 0.1 / a
        m += t
        np.multiply(t, t, out=t)
        t *= 0.1 * a * a / b
        v += t
        np.sqrt(v, out=t)
        t += 1e-8 / c
        np.divide(m, t, out=t)
        t *= self.rate * a / ((1 - a) * c)
        x -= t


def rested(table: np.ndarray, steps: int, rate: float, decay: float) -> np.ndarray:
    """All rows after so many steps without slopes."""
    out = table.copy()
    for i in range(0, len(out), CACHED):
        block = out[i : i + CACHED]
        block[:] = Vectors(block, rate, decay).at(np.arange(len(block)), steps)
    return out


def clipped(parts: list[np.ndarray], most: float) -> float:
    """The factor that brings the norm of all parts down to `most`."""
    norm = np.sqrt(sum(float((p * p).sum()) for p in parts))
    return min(1.0, most / (norm + 1e-6))


CHANGES = f"kind string, id long, n long, g {VECTOR}"


def _flat(arrays: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([arrays[k].reshape(-1) for k in sorted(arrays)])


def _unflat(flat: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def changes(rows: DataFrame, vectors: DataFrame, model: Model, parts: int, everywhere: bool, rate: float, margin: float, decay: float, clip: float, dropout: float, seed: int) -> DataFrame:
    """CHANGES of each part, summed over its n tasks: of vectors by id; and, flat in rows of `dimensions` numbers, of the
    weights, their new moments, and the sum of losses with the number of batches. rows: dealt() to `parts`; vectors: id, vector.

    A part gets each vector that occurs in it once, whatever the number of its facts; everywhere: each vector, where parts
    draw about as many entities as there are. An unknown drawn entity counts as the fact's own object, which no loss is
    taken of. Vectors that only a batch's messages drew get no slopes; how decay moves them is the same in all tasks of
    as many batches, and computed once a part.
    """
    spark, layers, origin, steps = rows.sparkSession, model.layers, model.origin, model.steps
    held = spark.sparkContext.broadcast((model.weights, model.moments))  # a few matrices of `dimensions` squared
    d = len(model.weights["q.out_bias"])

    def task(table: np.ndarray, still: dict[int, np.ndarray], batch: np.ndarray, at: np.ndarray, time: np.ndarray, others: np.ndarray) -> tuple:
        """Rows of the table with their changes; and the flat rest by kind. still: rested() of the table for the first task's
        number of batches, which nearly all have."""
        first, moments = held.value
        numbers, begin, size = np.unique(batch, return_index=True, return_counts=True)
        asks = np.arange(len(batch)) - np.repeat(begin, size) >= np.repeat((size + 1) // 2, size)
        met = np.zeros(len(table), np.int8)
        met[others.reshape(-1)] = 1
        met[at.reshape(-1)] = met[others[asks].reshape(-1)] = 2  # these get slopes
        idle, used = np.flatnonzero(met == 1), np.flatnonzero(met == 2)
        place = np.zeros(len(table), np.int64)
        place[used] = np.arange(len(used))
        at, others = place[at], place[others]  # the first half's drawn ones are not looked at
        start = _flat(first)
        flat, x = start.copy(), Vectors(table[used], rate, decay)
        w = _unflat(flat, first)  # views of it
        had = {"w": tuple(_flat({k: y[i] for k, y in moments.items()}) for i in (0, 1))} if moments else None
        of_weights, losses = Adam(rate, decay, had, steps * PER_TASK if moments else 0), []
        for step, (b, low, n) in enumerate(zip(numbers, begin, size)):
            mine, half = slice(low, low + n), (n + 1) // 2
            facts, drawn = at[mine], others[mine]
            rng = np.random.default_rng([seed, int(b)])
            mask = (rng.random((n // 2, 2 * d)) >= dropout) / (1 - dropout) if dropout else 1.0
            # only entities and relations of the batch have slopes
            e_rows, e_at = np.unique(facts[:, 1], return_inverse=True)
            h_rows, h_at = np.unique(np.concatenate([facts[:, 0], facts[:, 2], drawn[half:].reshape(-1)]), return_inverse=True)
            index = np.stack([h_at[:n], e_at, h_at[n : 2 * n]], axis=1)
            local = np.zeros_like(drawn)
            local[half:] = h_at[2 * n :].reshape(-1, drawn.shape[1])
            h, e = np.split(x.at(np.concatenate([h_rows, e_rows]), step), [len(h_rows)])
            loss, g, d_h, d_e = batch_gradient(w, layers, h, e, index, time[mine], local, margin, mask)
            scale = clipped([*g.values(), d_h, d_e], clip)
            of_weights.step({"w": flat}, {"w": _flat(g) * scale})
            x.step(np.concatenate([d_h, d_e]) * scale)
            losses.append(loss)
        k = len(numbers)
        if not still:
            still[k] = rested(table, k, rate, decay)
        rest = still[k][idle] if k in still else rested(table[idle], k, rate, decay)
        moved = np.concatenate([x.at(np.arange(len(used)), k) - table[used], rest - table[idle]])
        m, v = of_weights.moments["w"]
        return np.concatenate([used, idle]), moved, {"weights": flat - start, "m": m, "v": v, "loss": np.array([sum(losses), float(len(losses))])}

    def run(facts: pa.Table, known: pa.Table) -> pa.Table:
        if not len(facts) or not len(known):
            return pa.table({"kind": pa.array([], pa.string()), "id": pa.array([], pa.int64()), "n": pa.array([], pa.int64()), "g": _lists(np.zeros((0, d)))})
        ids, table = known["id"].to_numpy(), _matrix(known["vector"])
        order = np.argsort(ids)
        ids, table = ids[order], table[order]
        batch, day, row, *at = (facts[c].to_numpy() for c in ("batch", "day", "row_id", "s", "r", "o"))
        order = np.lexsort((row, day, batch))
        batch, day, at, others = batch[order], day[order], np.stack(at, axis=1)[order], _matrix(facts["others"])[order]
        low, high = min(int(x.min(initial=0)) for x in (ids, at, others)), max(int(x.max(initial=0)) for x in (ids, at, others))
        place = np.full(high - low + 1, -1)
        place[ids - low] = np.arange(len(ids))
        at, others = place[at - low], place[others - low]
        here = (at >= 0).all(axis=1)
        at, others, batch, time = at[here], others[here], batch[here], (day[here] - origin) / YEAR
        others = np.where(others >= 0, others, at[:, 2:])
        total, n, flat, tasks, still = np.zeros_like(table), np.zeros(len(table), np.int64), {}, np.unique(batch // PER_TASK), {}
        for t in tasks:
            mine = slice(*np.searchsorted(batch, [t * PER_TASK, (t + 1) * PER_TASK]))
            used, moved, more = task(table, still, batch[mine], at[mine], time[mine], others[mine])
            total[used] += moved
            n[used] += 1
            flat = {k: flat.get(k, 0) + v for k, v in more.items()}
        met = n > 0
        kinds, keys, counts, values = ["vector"] * int(met.sum()), [ids[met]], [n[met]], [total[met]]
        for k, v in flat.items():
            v = np.append(v, np.zeros(-len(v) % d)).reshape(-1, d)
            kinds += [k] * len(v)
            keys, counts, values = [*keys, np.arange(len(v))], [*counts, np.full(len(v), len(tasks))], [*values, v]
        return pa.table({"kind": pa.array(kinds, pa.string()), "id": np.concatenate(keys), "n": np.concatenate(counts), "g": _lists(np.concatenate(values).reshape(-1, d))})

    if everywhere:
        known = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("to"), "id", "vector")
    else:
        wanted = rows.select(F.col("part").alias("to"), F.explode(F.concat("others", F.array("s", "r", "o"))).alias("id")).distinct()
        known = wanted.join(vectors.select("id", "vector"), "id").select("to", "id", "vector")
    return rows.groupBy("part").cogroup(known.repartitionById(parts, F.col("to")).groupBy("to")).applyInArrow(run, CHANGES)


def _mean_weights(means: DataFrame) -> tuple[dict[str, np.ndarray], float]:
    """The means over tasks that are not of vectors, by kind, and the mean loss; a few thousand numbers."""
    got: dict[str, list] = {}
    for r in means.where("kind <> 'vector'").orderBy("kind", "id").collect():
        got.setdefault(r["kind"], []).extend(r["g"])
    loss, batches = got.pop("loss", (0.0, 1.0))[:2]
    return {k: np.array(x) for k, x in got.items()}, loss / batches


def train(facts: DataFrame, model: Model, epochs: int = 3, rate: float = 0.01, batch: int = 256, negatives: int = 10, margin: float = 0.5, decay: float = 1e-5, clip: float = 1.0, dropout: float = 0.1, seed: int = 42) -> tuple[Model, list[float]]:
    """The model after `epochs` rounds, each of an Adam step per batch, with weight decay, dropout and gradients clipped to
    a norm of `clip`; and the mean loss of each round. Moments of the weights go on from round to round and are kept with
    the model; those of vectors begin anew in each round."""
    losses = []
    d = len(model.weights["q.out_bias"])
    rows, names, total = keyed(facts)
    tables = {"entity": model.entities, "relation": model.relations}
    parts = [table.select("name", "vector").join(names.where(F.col("kind") == kind), "name").select("id", "vector") for kind, table in tables.items()]
    vectors = durable(parts[0].union(parts[1]), "vectors")
    n, *_, to = layout(rows, batch)
    everywhere = n * negatives >= to * total
    for _ in range(epochs):
        now = seed + model.steps
        changed = changes(dealt(rows, total, batch, negatives, now), vectors, model, to, everywhere, rate, margin, decay, clip, dropout, now)
        by = changed.groupBy("kind", "id").agg(F.sum("n").alias("n"), *_sums("g", d, "g", F.lit(1.0)))
        by = durable(by.select("kind", "id", _gathered("g", d, "n")), "mean-changes")
        mean, loss = _mean_weights(by)
        losses.append(loss)
        moved = vectors.join(by.where("kind = 'vector'").select("id", "g"), "id", "left")
        before, vectors = vectors, durable(moved.select("id", F.when(F.col("g").isNull(), F.col("vector")).otherwise(F.zip_with("vector", "g", lambda x, g: x + g)).alias("vector")), "vectors")
        weights, moments = model.weights, model.moments
        if mean:
            weights = {k: weights[k] + x for k, x in _unflat(mean["weights"], weights).items()}
            m, v = (_unflat(mean[k], weights) for k in ("m", "v"))
            moments = {k: (m[k], v[k]) for k in weights}
        forget(before, by)
        model = replace(model, weights=weights, moments=moments, steps=model.steps + 1)
    new = names.join(vectors, "id").select("kind", "name", F.col("vector").alias("new"))

    def named(kind: str) -> DataFrame:
        had = tables[kind].select("name", "vector").join(new.where(F.col("kind") == kind).drop("kind"), "name", "left")
        return durable(had.select("name", F.coalesce("new", "vector").alias("vector")), kind)

    model = replace(model, entities=named("entity"), relations=named("relation"))
    forget(rows, names, vectors)
    return model, losses


# --- storage -----------------------------------------------------------------------------------------------------------


def save(model: Model, path: str) -> None:
    """The model as Parquet: tables of vectors, and one of weights."""
    spark = model.entities.sparkSession
    for name, table in (("entities", model.entities), ("relations", model.relations)):
        table.write.mode("overwrite").parquet(f"{path}/{name}")
    about = json.dumps({"origin": model.origin, "layers": model.layers, "steps": model.steps})
    numbers = lambda x: None if x is None else [float(v) for v in x.reshape(-1)]
    rows = [(k, list(map(int, w.shape)), numbers(w), *map(numbers, model.moments.get(k, (None, None))), about) for k, w in sorted(model.weights.items())]
    spark.createDataFrame(rows, f"name string, shape array<int>, w {VECTOR}, m {VECTOR}, v {VECTOR}, about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/weights")


def load(spark: SparkSession, path: str) -> Model | None:
    """What save() has written, with the moments of its training; None if there is nothing."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/weights")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return None
    rows = spark.read.parquet(f"{path}/weights").collect()
    about = json.loads(rows[0]["about"])
    weights = {r["name"]: np.array(r["w"]).reshape(r["shape"]) for r in rows}
    moments = {r["name"]: tuple(np.array(r[c]).reshape(r["shape"]) for c in ("m", "v")) for r in rows if r["m"] is not None}
    tables = [spark.read.parquet(f"{path}/{name}") for name in ("entities", "relations")]
    return Model(weights, *tables, about["origin"], about["layers"], about["steps"], moments)
