"""Stupid-backoff scores of documents under the n-gram counts of the rest of the corpus.

Counts of all n-grams up to ORDER are summed over the whole corpus in tables partitioned by hash, and joined back to
the n-grams of each chunk of texts. A document's own n-grams are taken off before its words are scored, so its score
says how well all other documents predict it:

    S(w | v) = c(v w) / c(v) if c(v w) > 0 else BACKOFF * S(w),  S(w) = c(w) / N if c(w) > 0 else 1 / (N + 1)

with longer contexts first for higher orders. A score is the sum of natural logarithms over all words of the text.

Edge cases: null and empty texts have no words, score 0 and a null mean; every input row gives one output row, and
rows that repeat a text count as further documents; further columns are ignored; an empty table gives an empty
result. A corpus of one document has no counts left, so each of its words scores as unseen.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.llm.counting import count_keys
from factline.llm.text import ALNUM, Words, blocks

ORDER = 2
BACKOFF = 0.4
RESULT = "doc_id long, n_words long, n_seen long, log_score double, mean_log_score double"
U = np.uint64


def _grams(texts: list[bytes | None], order: int):
    """Per block: its first text, the words, and per n up to `order` the n-gram hashes and their last words."""
    for a, b in blocks(texts):
        words = Words(texts[a:b], ALNUM)
        yield a, words, [(words.hash, np.arange(len(words.hash)))] + [(h, at + n - 1) for n in range(2, order + 1) for h, at in [words.ngrams(n)]]


def keys_of(texts: list[bytes | None], order: int = ORDER) -> np.ndarray:
    """All n-grams of the texts, block by block and order by order."""
    parts = [h for _, _, grams in _grams(texts, order) for h, _ in grams]
    return np.concatenate(parts) if parts else np.zeros(0, U)


def _own(hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each n-gram how often its own text has it."""
    if not len(hashes):
        return np.zeros(0, np.int64)
    order = np.lexsort((hashes, doc))
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    group = np.cumsum(new) - 1
    out = np.empty(len(h), np.int64)
    out[order] = np.bincount(group)[group]
    return out


def word_scores(words: Words, grams: list, counts: list[np.ndarray], total: int, backoff: float = BACKOFF) -> tuple[np.ndarray, np.ndarray]:
    """Log score of each word, and whether its longest n-gram was seen elsewhere."""
    own_words = np.bincount(words.doc, minlength=len(words.count))
    rest = np.maximum(total - own_words[words.doc], 0).astype(float) if len(words.doc) else np.zeros(0)
    left = [c - _own(h, words.doc[last]) for (h, last), c in zip(grams, counts)]
    single = left[0].astype(float)
    score = np.where(single > 0, np.log(np.maximum(single, 1)) - np.log(np.maximum(rest, 1)), -np.log(rest + 1))
    seen = np.zeros(len(score), bool)
    for n in range(2, len(grams) + 1):
        _, last = grams[n - 1]
        have = left[n - 1]
        # the context of the n-gram that ends at `last` is the (n - 1)-gram that ends one word before
        before = np.searchsorted(grams[n - 2][1], last - 1)
        context = left[n - 2][before]
        good = have > 0
        longer = np.log(np.maximum(have, 1)) - np.log(np.maximum(context, 1))
        score[last] = np.where(good, longer, score[last] + math.log(backoff))
        seen[last] = good
    return score, seen


def _total_words(docs: DataFrame) -> int:
    """N: words of the whole corpus."""

    def run(batches):
        for batch in batches:
            texts = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(Words(texts[a:b], ALNUM).start) for a, b in blocks(texts))], pa.int64())], names=["n"])

    return docs.select(F.col("text").cast("binary")).mapInArrow(run, "n long").agg(F.sum("n")).collect()[0][0] or 0


def score(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF) -> DataFrame:
    """RESULT for each document. n_seen: words whose longest n-gram other documents have."""
    total = _total_words(docs)

    def finish(rows: pa.Table, totals) -> pa.Table:
        texts = rows["text"].to_pylist()
        counts, at = totals(keys_of(texts, order)), 0
        n, seen_words, sums = [], [], []
        for _, words, grams in _grams(texts, order):
            mine = []
            for h, _ in grams:
                mine.append(counts[at : at + len(h)])
                at += len(h)
            each, seen = word_scores(words, grams, mine, total, backoff)
            m = len(words.count)
            n += words.count.tolist()
            seen_words += np.bincount(words.doc[seen], minlength=m).tolist()
            sums += np.bincount(words.doc, weights=each, minlength=m).tolist() if len(each) else [0.0] * m
        mean = [s / k if k else None for s, k in zip(sums, n)]
        return pa.table({"doc_id": rows["doc_id"], "n_words": pa.array(n, pa.int64()), "n_seen": pa.array(seen_words, pa.int64()), "log_score": pa.array(sums, pa.float64()), "mean_log_score": pa.array(mean, pa.float64())})

    return count_keys(docs.select("doc_id", "text"), lambda texts: keys_of(texts, order), finish, RESULT, width=6, keys_per_word=float(order))
