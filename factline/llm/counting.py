"""Corpus-wide counts of hashed keys, brought back to the texts they come from.

Texts are dealt to chunks of CHUNK_BYTES on average. Each chunk sends its distinct keys with their counts to buckets by hash (so
that a key that is in every text arrives once per chunk, not once per text); a bucket sums them and answers each
chunk; the chunk meets its answers again in a cogroup. Keys travel without the bits that the bucket implies, as
sorted byte planes that the shuffle's compression shortens. Rows are at most min(chunks * buckets, keys).

Both uses of the chunked texts share one exchange. Two keys of one bucket with equal low bits (`width` bytes) count
as one: with 6 bytes and about a million keys a bucket that is fewer than one key in 10^8.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factline.session import small_batches

CHUNK_BYTES = 4_000_000
KEYS_PER_BUCKET = 600_000
RUN = 64  # rows that lie together, of which equal ones stay together
U = np.uint64


def pack(values: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of unsigned 64-bit values, plane by plane."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes, width: int) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<u8").reshape(-1)


class Dealer:
    """Maps keys to (bucket, low bits) as one sortable number, the same in every task."""

    def __init__(self, buckets: int, width: int):
        self.buckets, self.width = buckets, width

    def place(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bucket = ((keys >> U(40)) * U(self.buckets)) >> U(24)
        return bucket, keys & U((1 << 8 * self.width) - 1)

    def distinct(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Bucket and low bits of the distinct keys in order, each key's index among them, and how often each is there."""
        bucket, low = self.place(keys)
        order = np.lexsort((low, bucket))
        b, x = bucket[order], low[order]
        new = np.ones(len(x), bool)
        new[1:] = (b[1:] != b[:-1]) | (x[1:] != x[:-1])
        group = np.cumsum(new) - 1
        index = np.empty(len(x), np.int64)
        index[order] = group
        return b[new], x[new], index, np.bincount(group, minlength=int(new.sum())) if len(x) else np.zeros(0, np.int64)


def count_keys(
    docs: DataFrame,
    keys_of: Callable[[list[bytes | None]], np.ndarray],
    finish: Callable[[pa.Table, Callable[[np.ndarray], np.ndarray]], pa.Table],
    schema: str,
    width: int,
    keys_per_word: float = 1.0,
    salt: int = 0,
) -> DataFrame:
    """Rows of `schema`: finish(rows of a chunk, totals) where totals(keys) gives the corpus-wide count of each key.

    keys_of: the keys of some texts, each as often as it counts. totals takes exactly what keys_of gives for the
    chunk's texts.
    """
    small_batches(docs.sparkSession)
    size = docs.agg(F.sum(F.octet_length("text"))).collect()[0][0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    dealer = Dealer(max(1, int(size / 6 * keys_per_word) // KEYS_PER_BUCKET), width)
    # dealt by where a row stands, so that neither equal texts nor equal ids meet in one chunk
    chunk = F.pmod(F.xxhash64("doc_id", F.octet_length("text"), F.floor(F.monotonically_increasing_id() / RUN), F.lit(salt)), F.lit(chunks)).alias("chunk")
    texts = docs.select(chunk, F.col("doc_id").cast("long"), F.col("text").cast("binary"))

    def ask(table: pa.Table) -> pa.Table:
        bucket, low, _, n = dealer.distinct(keys_of(table["text"].to_pylist()))
        edges = np.flatnonzero(np.diff(bucket)) + 1
        begin = np.concatenate([[0], edges]).astype(int) if len(bucket) else []
        end = np.concatenate([edges, [len(bucket)]]).astype(int) if len(bucket) else []
        return pa.table(
            {
                "chunk": pa.array([table["chunk"][0].as_py()] * len(begin), pa.int64()),
                "bucket": pa.array([int(bucket[a]) for a in begin], pa.int64()),
                "low": pa.array([pack(low[a:b], width) for a, b in zip(begin, end)], pa.binary()),
                "n": pa.array([pack(n[a:b], 4) for a, b in zip(begin, end)], pa.binary()),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        lows = [unpack(x, width) for x in table["low"].to_pylist()]
        counts = np.concatenate([unpack(x, 4) for x in table["n"].to_pylist()])
        _, index = np.unique(np.concatenate(lows), return_inverse=True)
        total = np.bincount(index, weights=counts)[index].astype(U)
        cuts = np.cumsum([0, *map(len, lows)])
        packed = [pack(total[a:b], 6) for a, b in zip(cuts[:-1], cuts[1:])]
        return pa.table({"chunk": table["chunk"], "bucket": table["bucket"], "total": pa.array(packed, pa.binary())})

    def close(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("bucket")

        def totals(keys: np.ndarray) -> np.ndarray:
            _, _, index, _ = dealer.distinct(keys)
            parts = [unpack(x, 6) for x in right["total"].to_pylist()]
            return np.concatenate(parts)[index].astype(np.int64) if parts else np.zeros(0, np.int64)

        return finish(left, totals)

    asked = texts.groupBy("chunk").applyInArrow(ask, "chunk long, bucket long, low binary, n binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, total binary")
    return texts.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(close, schema)
