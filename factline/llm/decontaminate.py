"""Benchmark decontamination by a broadcast set of test n-grams.

The benchmark's windows (10 consecutive words; a shorter item is one window) are measured and, if they take at most
BROADCAST_BYTES, hashed and broadcast as packed arrays; each task looks up the windows of its training texts, compares
the words of a hit with the item's words, and marks every document word inside a true occurrence. Of larger benchmarks
the windows that no text has are dropped first, by the distinct hashes of the texts' windows; what is left takes the same
way if it fits, and else is joined by shuffle (`join_windows`), hashes first and words for hits only. All ways have the
same result.

Edge cases: null and empty texts have no words, and so no hits; null, empty and wordless items have no window;
items with equal windows all count as occurring; repeated rows give one result row each; further columns of the
documents are kept by `remove` and ignored by `scan`; an empty table on either side gives no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.text import ALNUM, Words, alnum_words, blocks, free_name
from factline.session import durable, small_batches

WIDTH = 10
BROADCAST_BYTES = 50_000_000  # of packed windows and item ids; a bound, not a sample
WINDOW_BYTES = 40  # what a window takes beside its words and ids
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def windows(benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """(window array<string>, items array<string>): each distinct window and the sorted ids of the items with it."""
    words = alnum_words(F.col("text"))
    cut = F.when(F.size("w") > width, F.transform(F.sequence(F.lit(1), F.size("w") - width + 1), lambda i: F.slice("w", i, width))).otherwise(F.array("w"))
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("w")).where(F.size("w") > 0)
    return rows.select("item", F.explode(cut).alias("window")).groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))


def packed_bytes(found: DataFrame) -> int:
    """The size of windows() in packed form, counted where they are."""
    ids = F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x) + 4)
    return found.agg(F.sum(F.octet_length(F.array_join("window", " ")) + ids + WINDOW_BYTES)).collect()[0][0] or 0


def _hashed(found: DataFrame) -> DataFrame:
    """windows() with the hash `h` of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n = batch.column("words").to_pylist(), batch.column("n").to_numpy()
            h = np.zeros(len(n), np.uint64)
            for length in np.unique(n):
                at = np.flatnonzero(n == length)
                h[at] = Words([words[i] for i in at], ALNUM).ngrams(int(length))[0]
            yield pa.RecordBatch.from_arrays([batch.column("window"), batch.column("items"), pa.array(h.view(np.int64))], names=["window", "items", "h"])

    packed = F.array_join("window", " ").cast("binary").alias("words")
    return found.select("window", "items", F.size("window").alias("n"), packed).mapInArrow(run, "window array<string>, items array<string>, h long")


def _lengths(found: DataFrame) -> list[int]:
    return sorted(r[0] for r in found.select(F.size("window")).distinct().collect())  # at most `width` values


def _occurring(docs: DataFrame, found: DataFrame) -> DataFrame:
    """windows() that some text of `docs` has, by hash, written once with that hash. Only distinct hashes are shuffled."""
    lengths = _lengths(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for a, b in blocks(texts):
                words = Words(texts[a:b], ALNUM)
                for n in lengths:
                    yield pa.RecordBatch.from_arrays([pa.array(np.unique(words.ngrams(n)[0]).view(np.int64))], names=["h"])

    seen = docs.select(F.col("text").cast("binary")).mapInArrow(run, "h long").distinct()
    return durable(_hashed(found).join(seen, "h", "left_semi"), "occurring")


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


@dataclass
class Known:
    """The windows of one length: their hashes in order, and of each the words (joined by spaces) and the item ids."""

    hashes: np.ndarray
    words: pa.Array
    items: pa.Array

    def at(self, h: np.uint64, words: bytes) -> list[str] | None:
        for i in range(int(np.searchsorted(self.hashes, h, "left")), int(np.searchsorted(self.hashes, h, "right"))):
            if self.words[i].as_py() == words:
                return self.items[i].as_py()
        return None


def _index(found: DataFrame) -> dict[int, Known]:
    """By window length, from the rows of windows(), which come to the driver as Arrow buffers."""
    rows = found.select(F.size("window").alias("n"), F.array_join("window", " ").cast("binary").alias("words"), "items").toArrow().combine_chunks()
    out, lengths = {}, rows["n"].to_numpy()
    for n in np.unique(lengths):
        part = rows.filter(pa.array(lengths == n)).combine_chunks()
        words = part["words"].combine_chunks()
        hashes = np.concatenate([Words(texts, ALNUM).ngrams(int(n))[0] for i in range(0, len(words), 10_000) for texts in [words[i : i + 10_000].to_pylist()]])
        order = np.argsort(hashes, kind="stable")
        out[int(n)] = Known(hashes[order], words.take(pa.array(order)), part["items"].combine_chunks().take(pa.array(order)))
    return out


def _find(texts: list[bytes | None], known: dict[int, Known]):
    """Per text: number of words, mask of hit words or None, items."""
    for a, b in blocks(texts):
        words = Words(texts[a:b], ALNUM)
        hit = np.zeros(len(words.hash), bool)
        items: dict[int, set[str]] = {}
        for length, windows_of in known.items():
            grams, at = words.ngrams(length)
            if not len(grams):
                continue
            place = np.minimum(np.searchsorted(windows_of.hashes, grams), len(windows_of.hashes) - 1)
            for i in np.flatnonzero(windows_of.hashes[place] == grams):
                first = int(at[i])
                got = b" ".join(words.data[s:e].tobytes() for s, e in zip(words.start[first : first + length], words.end[first : first + length]))
                ids = windows_of.at(grams[i], got)
                if ids is not None:
                    hit[first : first + length] = True
                    items.setdefault(int(words.doc[first]), set()).update(ids)
        for d in range(b - a):
            span = slice(words.first[d], words.first[d + 1])
            yield a + d, words, d, hit[span], items.get(d, set())


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, most: int = BROADCAST_BYTES) -> DataFrame:
    """One row per document: RESULT. most: bytes of windows that are broadcast."""
    small_batches(docs.sparkSession)
    found = windows(benchmark, width)
    if packed_bytes(found) > most:
        found = _occurring(docs, found)
        if packed_bytes(found) > most:
            return join_windows(docs, found)
    known = docs.sparkSession.sparkContext.broadcast(_index(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(words_of.count[d], int(hit.sum()), len(items), _digest(items)) for _, words_of, d, hit, items in _find(batch.column(1).to_pylist(), known.value)]
            n, h, k, sha = zip(*rows, strict=True) if rows else ([], [], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(k, pa.int64()), pa.array(sha, pa.string()), pa.array([x > 0 for x in h], pa.bool_())],
                names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, RESULT)


def _hits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(row, items, at): each occurrence of a window in `rows` (row, text); `at` are the positions of its words. Hashes of
    all places meet those of _occurring(); only places that meet one go back to their text for its words."""
    lengths = _lengths(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in blocks(texts):
                words = Words(texts[a:b], ALNUM)
                for n in lengths:
                    h, at = words.ngrams(n)
                    doc = words.doc[at]
                    columns = [row[a + doc], (at - words.first[doc]).astype(np.int32), np.full(len(at), n, np.int32), h.view(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["row", "i", "n", "h"])

    places = rows.select("row", F.col("text").cast("binary")).mapInArrow(run, "row long, i int, n int, h long")
    met = places.join(found.select("h"), "h", "left_semi").groupBy("row").agg(F.collect_list(F.struct("i", "n")).alias("met"))
    words = rows.select("row", alnum_words(F.col("text")).alias("w")).join(met, "row")
    cut = F.transform("met", lambda x: F.struct(x["i"].alias("i"), F.slice("w", x["i"] + 1, x["n"]).alias("window")))
    hit = words.select("row", F.explode(cut).alias("x")).select("row", "x.i", "x.window")
    return hit.join(found, "window").select("row", "items", F.sequence("i", F.col("i") + F.size("window") - 1).alias("at"))


def _numbered(docs: DataFrame, row: str = "row") -> DataFrame:
    """`docs` with row numbers, written once, so that all uses see the same."""
    return durable(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")


def join_windows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """As scan(), where the windows of _occurring(), `found`, are beyond the bound as well: they meet in shuffle joins.

    Only occurring windows come back to a document, so what is gathered per document is bounded by its own words.
    """
    rows = _numbered(docs.select(F.col("doc_id").cast("long"), "text"))
    hits = durable(_hits(rows.select("row", "text"), found), "hits")
    words = hits.select("row", F.explode("at").alias("at")).distinct().groupBy("row").agg(F.count("*").alias("n_hit"))
    items = hits.select("row", F.explode("items").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = rows.select("row", "doc_id", F.size(alnum_words(F.col("text"))).cast("long").alias("n_words")).join(words, "row", "left").join(items, "row", "left")
    ids = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _cut(raw: bytes, words: Words, d: int, hit: np.ndarray, whole_above: float) -> str | None:
    """Text d of `words` without its hit words and what stands between words of one run; None if too many are hit."""
    if hit.sum() > whole_above * len(hit):
        return None
    base, first = words.offsets[d], words.first[d]
    edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(edge[::2], edge[1::2]):
        out.append(raw[at : words.start[first + a] - base])
        at = int(words.end[first + b - 1] - base)
    return b"".join([*out, raw[at:]]).decode()


def _changed(batch: pa.RecordBatch, changed: dict[int, str | None], columns: list[str]) -> pa.RecordBatch:
    """The batch's `columns` with changed texts and their n_chars; rows whose text is None go."""
    out = []
    for name in columns:
        column = batch.column(name)
        if changed and name in ("text", "n_chars"):
            values = column.to_pylist()
            for i, t in changed.items():
                values[i] = t if name == "text" else len(t or "")
            column = pa.array(values, column.type)
        out.append(column)
    keep = np.ones(batch.num_rows, bool)
    keep[[i for i, t in changed.items() if t is None]] = False
    return pa.RecordBatch.from_arrays(out, names=columns).filter(pa.array(keep))


def remove(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, whole_above: float = 0.5, most: int = BROADCAST_BYTES) -> DataFrame:
    """`docs` without what `benchmark` holds: documents with more than `whole_above` of their words hit go, in others
    the hit words and all that stands between words of one hit run are cut out and n_chars follows. The columns stay.
    """
    small_batches(docs.sparkSession)
    found, names = windows(benchmark, width), docs.columns
    fits = packed_bytes(found) <= most
    if not fits:
        found = _occurring(docs, found)
        fits = packed_bytes(found) <= most
    if fits:
        known = docs.sparkSession.sparkContext.broadcast(_index(found))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw = batch.column("text").cast(pa.binary()).to_pylist()
                changed = {i: _cut(raw[i], words, d, hit, whole_above) for i, words, d, hit, _ in _find(raw, known.value) if hit.any()}
                yield _changed(batch, changed, names)

        return docs.mapInArrow(run, docs.schema)

    row, hit_row, hit_at = (free_name(x, names) for x in ("row", "hit_row", "hit_at"))
    rows = _numbered(docs, row)
    hits = _hits(rows.select(F.col(row).alias("row"), "text"), found)
    marked = hits.select(F.col("row").alias(hit_row), F.explode("at").alias("at")).groupBy(hit_row).agg(F.collect_set("at").alias(hit_at))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            changed = {}
            for i, (text, at) in enumerate(zip(batch.column("text").to_pylist(), batch.column(hit_at).to_pylist())):
                if at:
                    words = Words([text.encode()], ALNUM)
                    hit = np.zeros(len(words.hash), bool)
                    hit[at] = True
                    changed[i] = _cut(text.encode(), words, 0, hit, whole_above)
            yield _changed(batch, changed, names)

    return rows.join(marked, F.col(row) == F.col(hit_row), "left").select(*names, hit_at).mapInArrow(cut, docs.schema)
