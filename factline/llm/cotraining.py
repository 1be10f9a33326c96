"""Quality classifier by co-training on two views of a document.

The content view sees hashed words and the shape of the text, the metadata view only language, source and length.
Both are logistic regressions, fitted on the driver on a bounded sample: at most LABELLED documents with labels, half of
each class where there are as many, and at most HANDED_ROWS that a view is handed per round. What such rows bring to the
driver is bounded by the number of their features as well (ENTRIES): sizes come first, and rows beyond the bound are not
fitted on. The pool is all other documents: in each round both views score every one of them on the executors, and each
hands the other rows of its most confident share, which is a quantile of all scores. A row that was handed over leaves the
pool. A part of the labelled sample is held out, in three: one to calibrate each view's scores (Platt), one to weigh the
two views against each other, one for the threshold; classes count there by their shares among all labels. All documents
are then scored in one pass with the broadcast weights.

Edge cases: null and empty texts have only the shape features; null metadata are values of their own; labels that are
null, or of doc_ids that `docs` lacks, are left out, and of repeated labels of one doc_id the largest counts; of rows
that repeat a doc_id one is fitted on and all are scored; a row without doc_id is scored but never handed over; without
labels of both classes all scores are the share of ones (0.5 without any) and all documents are kept; every input row
gives one output row; further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factline.llm.text import SPACED, Words, blocks, fmix
from factline.session import durable, forget, small_batches

LABELLED = 4000
ROUNDS = 3
HANDED = 0.05  # share of the pool whose labels a view is sure of in a round, at most
HANDED_ROWS = 400  # rows of that share, drawn by hashed doc_id, that the other view is handed
ENTRIES = 4_000_000  # features that the rows of one draw may have together, about as many as 10,000 pages
PARTS = 256
BITS = 18
SHAPES = 8
META = 4096
LOST_GOOD = 0.005  # share of good held-out documents that the threshold may reject
U = np.uint64


@dataclass
class Rows:
    """A sparse matrix by rows: of each entry the row, column and value."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    n: int

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * weights[self.column], minlength=self.n)

    def transposed_times(self, v: np.ndarray, columns: int) -> np.ndarray:
        return np.bincount(self.column, weights=self.value * v[self.row], minlength=columns)

    def take(self, rows: np.ndarray) -> Rows:
        """The rows `rows`, in this order; a row may be taken more than once."""
        order = np.argsort(self.row, kind="stable")
        count = np.bincount(self.row, minlength=self.n)
        begin = np.concatenate([[0], np.cumsum(count)])[:-1][rows]
        n = count[rows]
        at = order[np.repeat(begin - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(int(n.sum()))]
        return Rows(np.repeat(np.arange(len(rows)), n), self.column[at], self.value[at], len(rows))

    @staticmethod
    def stack(parts: list[Rows]) -> Rows:
        above = np.concatenate([[0], np.cumsum([p.n for p in parts])]).astype(int)
        return Rows(np.concatenate([p.row + a for p, a in zip(parts, above)]), np.concatenate([p.column for p in parts]), np.concatenate([p.value for p in parts]), int(above[-1]))


def content(texts: list[bytes | None]) -> Rows:
    """Presence of hashed words, and SHAPES numbers about the text."""
    rows, columns, values = [], [], []
    for a, b in blocks(texts):
        words = Words(texts[a:b], SPACED)
        both = np.unique((words.doc.astype(U) << U(BITS)) | (words.hash & U((1 << BITS) - 1)))
        doc = (both >> U(BITS)).astype(np.int64)
        distinct = np.bincount(doc, minlength=b - a)
        rows.append(doc + a)
        columns.append((both & U((1 << BITS) - 1)).astype(np.int64))
        values.append(1 / np.sqrt(np.sqrt(np.maximum(distinct, 1)))[doc])
        size = np.maximum(np.diff(words.offsets), 1)
        count = np.maximum(words.count, 1)
        byte = lambda chars: np.array([sum((t or b"").count(c) for c in chars) for t in texts[a:b]])  # noqa: B023, E731
        upper = np.array([sum(map((t or b"").count, map(bytes, zip(range(65, 91))))) for t in texts[a:b]])
        shape = np.stack([byte([b"#", b"$", b"%", b"&", b"*", b"|", b"<", b">"]) / size * 20, upper / size * 10, byte([b"!"]) / size * 20, byte([b"\n"]) / count * 5, distinct / count, size / count / 8, np.log1p(words.count) / 8, np.ones(b - a)])
        rows.append(np.tile(np.arange(a, b), SHAPES))
        columns.append(np.repeat(np.arange(SHAPES) + (1 << BITS), b - a))
        values.append(np.clip(shape, 0, 3).ravel())
    if not rows:
        return Rows(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0)
    return Rows(np.concatenate(rows), np.concatenate(columns), np.concatenate(values), len(texts))


def metadata(lang: list, source: list, n_chars: list) -> Rows:
    """Hashed language, source, their pair and the length's power of two; and a constant."""
    known: dict[str, int] = {}

    def place(value: str) -> int:
        if value not in known:
            h = U(len(value) + 1)
            code = np.frombuffer(value.encode(), np.uint8).astype(U)
            h = fmix(np.array([int(h) + int((code * np.arange(1, len(code) + 1, dtype=U) * U(0x9E3779B97F4A7C15)).sum())], dtype=U))[0]
            known[value] = int(h % U(META - 1)) + 1
        return known[value]

    columns = [[0, place(f"l:{a}"), place(f"s:{b}"), place(f"p:{a}:{b}"), place(f"n:{c.bit_length() if c is not None and c >= 0 else None}")] for a, b, c in zip(lang, source, n_chars, strict=True)]
    flat = np.array(columns, np.int64).reshape(-1)
    return Rows(np.repeat(np.arange(len(columns)), 5), flat, np.ones(len(flat)), len(columns))


def fit(x: Rows, y: np.ndarray, columns: int, ridge: float = 1e-4, steps: int = 150) -> np.ndarray:
    """Logistic regression by Adam over all rows; classes weigh the same."""
    w = np.zeros(columns)
    m, v = np.zeros(columns), np.zeros(columns)
    weight = np.where(y > 0.5, 0.5 / max(1, (y > 0.5).sum()), 0.5 / max(1, (y <= 0.5).sum()))
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(x.times(w), -30, 30)))
        g = x.transposed_times(weight * (p - y), columns) + ridge * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def calibrate(scores: list[np.ndarray], y: np.ndarray, prior: float, steps: int = 800) -> np.ndarray:
    """(a, b1, b2, ...): log odds as a + sum of b * score, where ones have the share `prior`."""
    x = np.stack([np.ones(len(y)), *scores])
    scale = np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-9)
    weight = np.where(y > 0.5, prior / max(1, (y > 0.5).sum()), (1 - prior) / max(1, (y <= 0.5).sum()))
    z, w = x / scale, np.zeros(len(x))
    for _ in range(steps):
        w -= 2.0 * (z @ (weight * (1 / (1 + np.exp(-np.clip(w @ z, -30, 30))) - y)) + 1e-3 * w)
    return w / scale[:, 0]


@dataclass
class Model:
    """Weights of both views, their calibration, the combination, and the score from which a document is kept."""

    content: np.ndarray | None
    metadata: np.ndarray | None
    each: tuple[np.ndarray, np.ndarray] | None
    both: np.ndarray | None
    prior: float
    threshold: float

    def scores(self, a: Rows, b: Rows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities by content, by metadata, and by both."""
        if self.content is None:
            return (np.full(a.n, self.prior),) * 3
        odds = [np.clip(c[0] + c[1] * x, -30, 30) for c, x in zip(self.each, (a.times(self.content), b.times(self.metadata)))]
        mixed = np.clip(self.both[0] + self.both[1] * odds[0] + self.both[2] * odds[1], -30, 30)
        return tuple(1 / (1 + np.exp(-x)) for x in (*odds, mixed))


COLUMNS = ((1 << BITS) + SHAPES, META)


def held_out(y: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows to fit on; and every fifth of each class, in three parts (or three times all, if a part lacks a class)."""
    classes = [np.flatnonzero(y == c) for c in (0, 1)]
    held = [c[::5] for c in classes]
    train = np.sort(np.concatenate([np.delete(c, np.s_[::5]) for c in classes]))
    parts = [np.concatenate([h[k::3] for h in held]) for k in range(3)] if min(map(len, held)) >= 3 else [np.concatenate(held)] * 3
    return train, parts


@dataclass
class Training:
    """Of one label: the sample's features by both views and its labels, what the views were handed, and the weights."""

    a: Rows
    b: Rows
    y: np.ndarray
    prior: float
    handed: tuple[list[tuple[Rows, np.ndarray]], list[tuple[Rows, np.ndarray]]]
    weights: tuple[np.ndarray, np.ndarray] | None = None

    def fits(self) -> bool:
        train, parts = held_out(self.y)
        return all(len({*self.y[rows].tolist()}) == 2 for rows in (train, *parts))

    def fit(self) -> None:
        """Fit both views on the labelled rows and on what they were handed."""
        train, _ = held_out(self.y)
        views = (self.a.take(train), self.b.take(train))
        self.weights = tuple(fit(Rows.stack([views[i], *(x for x, _ in self.handed[i])]), np.concatenate([self.y[train], *(y for _, y in self.handed[i])]), COLUMNS[i]) for i in (0, 1))

    def model(self) -> Model:
        """Calibrated on the first held part, weighed on the second, with the threshold of the third."""
        if self.weights is None:
            return Model(None, None, None, None, self.prior, 0.0)
        _, (first, second, third) = held_out(self.y)
        raw = lambda rows: (self.a.take(rows).times(self.weights[0]), self.b.take(rows).times(self.weights[1]))
        each = tuple(calibrate([x], self.y[first], self.prior) for x in raw(first))
        odds = [np.clip(c[0] + c[1] * x, -30, 30) for c, x in zip(each, raw(second))]
        model = Model(*self.weights, each, calibrate(odds, self.y[second], self.prior), self.prior, 0.0)
        good = third[self.y[third] > 0.5]
        model.threshold = min(0.5, float(np.quantile(model.scores(self.a.take(good), self.b.take(good))[2], LOST_GOOD, method="lower")))
        return model


def known_labels(docs: DataFrame, labels: DataFrame, target: str) -> DataFrame:
    """(doc_id, y): one label of each doc_id that `docs` has."""
    by = labels.where(F.col(target).isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(target).cast("double").alias("y"))
    return by.join(docs.select("doc_id"), "doc_id", "left_semi")


def drawn(rows: DataFrame, n: int, salt: int) -> DataFrame:
    """n rows at most, those whose hashed doc_ids are smallest."""
    return rows.orderBy(F.xxhash64("doc_id", F.lit(salt)), "doc_id").limit(n)


def _turn(doc_id: int) -> int:
    """Where a handed row stands when a draw is cut: by its hashed id."""
    return int(fmix(np.array([doc_id]).astype(U))[0])


def _within(order: list[int], sizes: dict[int, int], most: int) -> list[int]:
    """The longest beginning of `order`, without ids that have no size, whose sizes sum to at most `most`."""
    known = [i for i in dict.fromkeys(order) if i in sizes]
    total = np.cumsum([sizes[i] for i in known])
    return known[: int(np.searchsorted(total, most, "right"))]


def features(docs: DataFrame, order: list[int], most: int = ENTRIES) -> tuple[list[int], Rows, Rows]:
    """doc_ids in order and both views' features of these rows, on the driver. order: doc_ids, a few thousand, the more
    wanted first; those beyond `most` features are left out. Of rows that repeat an id the first by content is taken, so
    no more rows come back than there are ids."""
    spark = docs.sparkSession
    ids = spark.createDataFrame([(i,) for i in dict.fromkeys(order)], "id long")
    rows = docs.join(F.broadcast(ids), F.col("doc_id") == F.col("id")).drop("id")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct(F.xxhash64("text", "lang", "source", "n_chars").alias("at"), "text", "lang", "source", "n_chars")).alias("x")).select("doc_id", "x.text", "x.lang", "x.source", "x.n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = content(batch.column(1).to_pylist())
            cut = np.argsort(x.row, kind="stable")
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(x.row, minlength=x.n))]).astype(np.int32))
            packed = [pa.ListArray.from_arrays(ends, pa.array(v[cut])) for v in (x.column.astype(np.int32), x.value.astype(np.float32))]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in (0, 2, 3, 4)], *packed], names=["doc_id", "lang", "source", "n_chars", "columns", "values"])

    made = durable(rows.mapInArrow(run, "doc_id long, lang string, source string, n_chars long, columns array<int>, values array<float>"), "features")
    fitting = _within(order, dict(made.select("doc_id", F.size("columns")).collect()), most)
    kept = spark.createDataFrame([(i,) for i in fitting], "doc_id long")
    got = made.join(F.broadcast(kept), "doc_id", "left_semi").toArrow().sort_by("doc_id").combine_chunks()
    forget(made)
    flat = lambda name: got[name].combine_chunks().flatten().to_numpy()
    each = np.diff(got["columns"].combine_chunks().offsets.to_numpy()) if len(got) else np.zeros(0, int)
    a = Rows(np.repeat(np.arange(len(got), dtype=np.int32), each), flat("columns"), flat("values"), len(got)) if len(got) else content([])
    return got["doc_id"].to_pylist(), a, metadata(*(got[c].to_pylist() for c in ("lang", "source", "n_chars")))


def raw_scores(docs: DataFrame, trainings: dict[str, Training]) -> DataFrame:
    """doc_id, and per training <name>_0 and <name>_1: the score of every document by each view's weights."""
    held = docs.sparkSession.sparkContext.broadcast({t: x.weights for t, x in trainings.items()})  # 2^18 weights per label
    schema = "doc_id long, " + ", ".join(f"{t}_{i} double" for t in trainings for i in (0, 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            views = content(batch.column(1).to_pylist()), metadata(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            scores = [pa.array(views[i].times(w[i]), pa.float64()) for w in held.value.values() for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *scores], names=[x.split()[0] for x in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def confident(pool: DataFrame, target: str, prior: float, handed: float, rows: int, salt: int) -> DataFrame:
    """(doc_id, view, y): rows of the pool that a view is surest of, ones and zeros in the labels' proportion, for the
    other view."""
    most = lambda i: F.expr(f"percentile_approx({target}_{i}, array({1 - handed * prior}D, {handed * (1 - prior)}D), 10000)")
    ends = pool.agg(*[most(i) for i in (0, 1)]).collect()[0]  # one row
    cases = []
    for i, end in enumerate(ends):
        if end:
            x = F.col(f"{target}_{i}")
            case = lambda y, sure: F.when(sure, F.struct(F.lit(i).alias("view"), F.lit(y).alias("y")))  # noqa: B023, E731
            cases += [case(1.0, (x >= end[0]) & (x > 1)), case(0.0, (x <= end[1]) & (x < -1))]
    found = pool.where("doc_id is not null").select("doc_id", F.explode(F.array_compact(F.array(*cases))).alias("x")).select("doc_id", "x.*").distinct() if cases else pool.select("doc_id", F.lit(0).alias("view"), F.lit(0.0).alias("y")).where("false")
    # the first by hash, found among the first of PARTS parts, so that no task gets more than PARTS * `rows` of a case
    order = (F.xxhash64("doc_id", F.lit(salt)), F.col("doc_id"))
    ones, zeros = max(1, int(rows * prior)), max(1, int(rows * (1 - prior)))
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(salt + 1)), F.lit(PARTS)))
    for by in (("view", "y", "part"), ("view", "y")):
        found = found.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= max(ones, zeros))
    return found.where(F.col("place") <= F.when(F.col("y") == 1, ones).otherwise(zeros)).drop("place", "part")


def train(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...], rounds: int = ROUNDS, handed: float = HANDED, rows: int = HANDED_ROWS, labelled: int = LABELLED, entries: int = ENTRIES) -> dict[str, Model]:
    """A model per label column. The labels' rounds go together, so that each round scores the documents once."""
    spark = docs.sparkSession
    known = {t: durable(known_labels(docs, labels, t), "labels") for t in targets}
    sample = {}
    for t in targets:
        parts = [drawn(known[t].where(F.col("y") == c), labelled // 2, 6) for c in (0.0, 1.0)]
        sample[t] = [[(r["doc_id"], r["y"]) for r in p.collect()] for p in parts]  # `labelled` rows at most
    # classes and labels take turns, so that a draw cut at `entries` keeps their shares
    turns = sorted((k, i) for t in targets for part in sample[t] for k, (i, _) in enumerate(part))
    found, a, b = features(docs, [i for _, i in turns], entries)
    place = {d: i for i, d in enumerate(found)}
    training = {}
    for t in targets:
        prior = known[t].agg(F.avg("y")).collect()[0][0]
        mine = [(place[i], y) for part in sample[t] for i, y in part if i in place]
        at = np.array([i for i, _ in mine], int)
        training[t] = Training(a.take(at), b.take(at), np.array([y for _, y in mine]), 0.5 if prior is None else prior, ([], []))
    open_ = {t: x for t, x in training.items() if x.fits()}
    gone: dict[str, set[int]] = {t: set() for t in targets}  # 4 * `rows` a round at most
    for r in range(rounds + 1):
        for x in open_.values():
            x.fit()
        if r == rounds or not open_:
            break
        pool = durable(raw_scores(docs, open_), "scores")
        found = []
        for t, x in open_.items():
            left = spark.createDataFrame([(i,) for i in sorted(gone[t])], "doc_id long")
            rest = pool.select("doc_id", f"{t}_0", f"{t}_1").join(known[t], "doc_id", "left_anti").join(F.broadcast(left), "doc_id", "left_anti")
            rest = durable(rest, "pool")
            found += [(c["doc_id"], t, c["view"], c["y"]) for c in confident(rest, t, x.prior, handed, rows, 60 + r).collect()]  # 2 * `rows` at most
            forget(rest)
        forget(pool)
        if not found:
            break
        chosen, a, b = features(docs, [int(d) for d in dict.fromkeys(f[0] for f in sorted(found, key=lambda f: _turn(f[0])))], entries)
        place = {d: i for i, d in enumerate(chosen)}
        for t, x in open_.items():
            for i in (0, 1):
                mine = sorted((d, y) for d, target, view, y in found if target == t and view == i and d in place)
                if mine:
                    x.handed[1 - i].append(((a, b)[1 - i].take(np.array([place[d] for d, _ in mine])), np.array([y for _, y in mine])))
                gone[t] |= {d for d, _ in mine}
    forget(*known.values())
    return {t: x.model() for t, x in training.items()}


def score(docs: DataFrame, models: dict[str, Model]) -> DataFrame:
    """doc_id, and per model <name>_content, <name>_metadata, <name>_score and <name>_above (its threshold)."""
    held = docs.sparkSession.sparkContext.broadcast(models)  # 2^18 weights per model
    schema = "doc_id long, " + ", ".join(f"{m}_content double, {m}_metadata double, {m}_score double, {m}_above boolean" for m in models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = content(batch.column(1).to_pylist()), metadata(*(batch.column(i).to_pylist() for i in (2, 3, 4)))
            columns = [batch.column(0)]
            for model in held.value.values():
                by = model.scores(a, b)
                columns += [pa.array(x, pa.float64()) for x in by] + [pa.array(by[2] >= model.threshold, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])

    return docs.mapInArrow(run, schema)


def classify(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality",), **settings: float) -> DataFrame:
    """score() of all documents with a model per label column, by train(**settings)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"), "lang", "source", F.col("n_chars").cast("long"))
    return score(docs, train(docs, labels, targets, **settings))
