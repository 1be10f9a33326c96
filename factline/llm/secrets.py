"""Secret scans: known forms, and a token-efficiency test for random strings.

Under a byte-pair vocabulary ordinary text takes few tokens per character, random strings many: a run of at least
LEAST_RUN characters with letters and fewer than most_ratio_of() characters per token is reported as `random`, unless it
is a known digest (32, 40, 56, 64, 96 or 128 hex digits), a UUID or an identifier of words and numbers, or lies in
another span. Runs without digits need a lower ratio, as words have none; so do runs of less than LONG_RUN
characters, and runs that signs such as ! . or $ cut, which count as one where little of them is words or numbers.

Edge cases: null and empty texts have no spans (the digest is that of the empty string); every input row gives one
output row, repeated rows too; further columns are ignored; an empty table gives an empty result. Offsets count code
points. All patterns take linear time on long texts.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factline.session import small_batches

VOCABULARY = "file:///opt/tokenizers/byte_bpe_50k.tiktoken"
MOST_VOCABULARY_BYTES = 64_000_000
MOST_RATIO = 2.2  # of long runs with digits
LEAST_RUN, LONG_RUN = 16, 20
LESS_SHORT, LESS_LETTERS, LESS_CUT = 0.4, 0.3, 0.4  # what short, digitless and long cut runs have less
LEAST_STRANGE = 0.75  # share of a cut run that must be in pieces that are no words or numbers
KINDS = ("assign", "access", "hex", "random")
RESULT = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"

_assign = re.compile(r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{24,}")
_run = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_cut_run = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]++(?:[!.$%&*~^?#]{1,2}[A-Za-z0-9+/_=-]++)++")
_signs = re.compile(r"[!.$%&*~^?#]+")
_digest = re.compile(r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128})\Z")
_uuid = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_identifier = re.compile(r"(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8})(?:[_/=+-]+(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]{1,8}))*\Z")
#: Cuts of a text before byte pairs are merged: contractions, letters, digits, other signs, spaces.
_cuts = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_encodings: dict[str, object] = {}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the first three kinds, kinds as numbers."""
    spans = []
    if "=" in text or ":" in text:
        spans += [(m.start(), m.end(), 0) for m in _assign.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), 1) for m in _access.finditer(text) if m.end() - m.start() >= 20]
    spans += [(m.start(), m.end(), 2) for m in _hex.finditer(text)]
    return sorted(spans)


def most_ratio_of(run: str, most_ratio: float = MOST_RATIO) -> float:
    """Characters per token from which a run counts as text."""
    return most_ratio - LESS_SHORT * (len(run) < LONG_RUN) - LESS_LETTERS * (not re.search(r"[0-9]", run))


def free_of(spans: list[tuple[int, int, int]]) -> Callable[[re.Match], bool]:
    """Whether a match lies outside all of `spans`: one search among them, once those that overlap are joined."""
    begins: list[int] = []
    ends: list[int] = []
    for s, e, _ in sorted(spans):
        if ends and s < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            begins.append(s)
            ends.append(e)

    def free(m: re.Match) -> bool:
        i = bisect_left(begins, m.end()) - 1
        return i < 0 or ends[i] <= m.start()

    return free


def random_spans(text: str, count_tokens, taken: list[tuple[int, int, int]], most_ratio: float = MOST_RATIO) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    known = lambda run: _digest.match(run) or _uuid.match(run)
    free = free_of(taken)
    for m in _cut_run.finditer(text):
        if m.end() - m.start() < LEAST_RUN or not re.search(r"[A-Za-z]", m[0]):
            continue
        pieces = _signs.split(m[0])
        strange = sum(len(x) for x in pieces if not _identifier.match(x))
        if strange < LEAST_STRANGE * sum(map(len, pieces)) or any(map(known, pieces)) or not free(m):
            continue
        if len(m[0]) / count_tokens(m[0]) < most_ratio_of(m[0], most_ratio) - LESS_CUT * (len(m[0]) >= LONG_RUN):
            out.append((m.start(), m.end(), 3))
    free = free_of(taken + out)
    for m in _run.finditer(text):
        run = m[0]
        if not re.search(r"[A-Za-z]", run) or known(run) or re.search(r"[0-9]", run) and _identifier.match(run) or not free(m):
            continue
        if len(run) / count_tokens(run) < most_ratio_of(run, most_ratio):
            out.append((m.start(), m.end(), 3))
    return sorted(out)


def read_vocabulary(spark: SparkSession, path: str) -> bytes:
    """The vocabulary file, read on the driver by any file system that Spark knows; its size is checked first."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    file = jvm.org.apache.hadoop.fs.Path(path)
    fs = file.getFileSystem(conf)
    if fs.getFileStatus(file).getLen() > MOST_VOCABULARY_BYTES:
        raise ValueError(f"{path} is larger than {MOST_VOCABULARY_BYTES} bytes")
    stream = fs.open(file)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def _encoding(key: str, vocabulary: bytes):
    if key not in _encodings:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encodings[key] = tiktoken.Encoding("ranks", pat_str=_cuts, mergeable_ranks=ranks, special_tokens={})
    return _encodings[key]


def token_counter(key: str, vocabulary: bytes):
    return lambda run: len(_encoding(key, vocabulary).encode_ordinary(run))


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, most_ratio: float = MOST_RATIO) -> DataFrame:
    """One row per document: RESULT. spans has all kinds, base_sha256 the digest of the first three."""
    small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(read_vocabulary(docs.sparkSession, vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = token_counter(vocabulary, held.value)
        for batch in batches:
            n: list[list[int]] = [[], [], [], []]
            sha, spans = [], []
            for text in batch.column(1).to_pylist():
                base = base_spans(text or "")
                every = sorted(base + random_spans(text or "", count, base, most_ratio))
                for k in range(4):
                    n[k].append(sum(x[2] == k for x in every))
                write = lambda xs: ",".join(f"{KINDS[k]}:{s}:{e}" for s, e, k in sorted(xs, key=lambda x: (x[0], x[2])))
                sha.append(hashlib.sha256(write(base).encode()).hexdigest())
                spans.append(write(every))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(x, pa.int64()) for x in n], pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=[x.split()[0] for x in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)
