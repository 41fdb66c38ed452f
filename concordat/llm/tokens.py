"""Token ids of a byte-level BPE vocabulary, looked up in two tiers.

Most pre-tokens are vocabulary entries: a minimal perfect hash finds them with one
probe. The rest are merged byte by byte with a heap over a linked list, so a run of
n bytes without a break costs n log n. The tables are built once on the driver from
a vocabulary of fixed size and broadcast.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from concordat.runtime import slices

#: Where the public vocabularies lie; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


class PerfectHash:
    """Minimal perfect hash: every key of a fixed set gets its own slot of as many slots as keys.

    Keys fall into small buckets; each bucket, the largest first, takes the first
    displacement that puts all its keys on free slots: a number of strides, a second
    hash of each key, and a shift common to all. ``slots`` answers for any string,
    so the caller compares the key that stands there.
    """

    def __init__(self, keys: list[bytes], per_bucket: int = 4):
        for self.seed in range(64):  # few keys may need another hash
            try:
                self._build(keys, per_bucket)
                return
            except ValueError:
                continue
        raise ValueError("no perfect hash found for these keys")

    def _build(self, keys: list[bytes], per_bucket: int) -> None:
        self.n = max(len(keys), 1)
        self.buckets = max(self.n // per_bucket, 1)
        bucket, base, stride = self._places(keys)
        self.strides, self.shift = np.zeros(self.buckets, np.int64), np.zeros(self.buckets, np.int64)
        taken = np.zeros(self.n, bool)
        members = np.split(np.argsort(bucket, kind="stable"), np.cumsum(np.bincount(bucket, minlength=self.buckets))[:-1])
        for b in sorted(range(self.buckets), key=lambda b: -len(members[b])):
            at = members[b]
            if len(at) > 1:
                self._place(b, base[at], stride[at], taken)
        single = [b for b in range(self.buckets) if len(members[b]) == 1]
        for b, slot in zip(single, np.flatnonzero(~taken), strict=True):
            self.shift[b] = (slot - base[members[b][0]]) % self.n
        self.order = np.zeros(self.n, np.int64)
        if keys:
            self.order[self.slots(keys)] = np.arange(len(keys))

    def _places(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = np.fromiter((xxhash.xxh64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys))
        with np.errstate(over="ignore"):
            a, b, c = ((h * m) >> np.uint64(20) for m in _MIX)
        n = np.uint64(self.n)
        return (a % np.uint64(self.buckets)).astype(np.int64), (b % n).astype(np.int64), (c % n).astype(np.int64)

    def _place(self, b: int, base: np.ndarray, stride: np.ndarray, taken: np.ndarray) -> None:
        for strides in range(100):
            start = (base + strides * stride) % self.n
            if len(np.unique(start)) < len(start):
                continue
            for low in range(0, self.n, 4096):
                shifts = np.arange(low, min(low + 4096, self.n))
                hits = taken[(start[:, None] + shifts[None]) % self.n].any(0)
                if not hits.all():
                    self.strides[b], self.shift[b] = strides, int(shifts[int(np.argmin(hits))])
                    taken[(start + self.shift[b]) % self.n] = True
                    return
        raise ValueError("keys of one bucket have equal hashes")

    def slots(self, keys: list[bytes]) -> np.ndarray:
        bucket, base, stride = self._places(keys)
        return (base + self.strides[bucket] * stride + self.shift[bucket]) % self.n


class ByteBpe:
    """Encoder of one vocabulary of ranks."""

    def __init__(self, path: str = VOCABULARY, tables: dict | None = None):
        """From a vocabulary file, or from the ``tables`` of another encoder."""
        if tables is None:
            with open(path, "rb") as lines:
                pairs = [line.split() for line in lines if line.strip()]
            words = [base64.b64decode(word) for word, _ in pairs]
            tables = {"words": words, "ids": np.array([int(rank) for _, rank in pairs], np.int64), "hash": vars(PerfectHash(words))}
        self.tables, self.words, self.ids = tables, tables["words"], tables["ids"]
        self.hash = PerfectHash.__new__(PerfectHash)
        vars(self.hash).update(tables["hash"])
        self.rank = dict(zip(self.words, self.ids.tolist(), strict=True))
        self.memo: dict[str, tuple[int, ...]] = {}

    def merged(self, word: bytes) -> tuple[int, ...]:
        """Ids of a pre-token outside the vocabulary: the lowest-ranked neighbouring pair merges first."""
        rank = self.rank
        piece: list[bytes | None] = [word[i : i + 1] for i in range(len(word))]
        after = list(range(1, len(word) + 1))
        before = list(range(-1, len(word) - 1))
        heap = [(r, i, 2) for i in range(len(word) - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            left, j = piece[i], after[i]
            if left is None or j >= len(word) or len(left) + len(piece[j]) != size:
                continue  # one side was merged otherwise since
            piece[i], piece[j], after[i] = left + piece[j], None, after[j]
            if after[j] < len(word):
                before[after[j]] = i
                both = piece[i] + piece[after[i]]
                if (r := rank.get(both)) is not None:
                    heapq.heappush(heap, (r, i, len(both)))
            if before[i] >= 0:
                both = piece[before[i]] + piece[i]
                if (r := rank.get(both)) is not None:
                    heapq.heappush(heap, (r, before[i], len(both)))
        return tuple(rank[p] for p in piece if p is not None)

    def learn(self, words: set[str]) -> None:
        """Put the ids of new pre-tokens into the memo, all of a batch in one probe of the hash."""
        fresh = [w for w in words if w not in self.memo]
        if not fresh:
            return
        raw = [w.encode() for w in fresh]
        found = self.hash.order[self.hash.slots(raw)]
        for word, key, at in zip(fresh, raw, found.tolist(), strict=True):
            self.memo[word] = (int(self.ids[at]),) if self.words[at] == key else self.merged(key)

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; an empty or null text has none."""
        if len(self.memo) > 200_000:
            self.memo.clear()
        split = [PRETOKENS.findall(t) if t else [] for t in texts]
        self.learn(set(chain.from_iterable(split)))
        memo = self.memo
        return [list(chain.from_iterable(map(memo.__getitem__, words))) for words in split]


PRETOKENS = regex.compile(PATTERN)


def _encoder(spark: SparkSession, path: str) -> Broadcast:
    """The tables of the encoder; being plain bytes and arrays, they can be read where the package is not installed."""
    return spark.sparkContext.broadcast(ByteBpe(path).tables)


def token_ids(documents: DataFrame, row_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(row_id, ids)``: the ids of every text without special tokens.

    An empty or null text gives an empty list, blanks are tokens, strings that look
    like special tokens are ordinary text. One narrow pass without a shuffle; texts
    of any length are encoded whole; other columns are ignored.
    """
    shared = _encoder(documents.sparkSession, vocabulary)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBpe(tables=shared.value)
        for batch in batches:
            for part in slices(batch):
                ids = encoder.encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32()))], [row_id, "ids"])

    kind = documents.schema[row_id].dataType.simpleString()
    return documents.select(row_id, text).mapInArrow(encode, f"`{row_id}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and ``n_tokens`` of every row; only counts leave the encoder."""
    shared = _encoder(documents.sparkSession, vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBpe(tables=shared.value)
        for batch in batches:
            for part in slices(batch):
                sizes = [len(ids) for ids in encoder.encode(part.column(len(keep)).to_pylist())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], pa.array(sizes, pa.int64())], [*keep, "n_tokens"])

    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)
    return documents.select(*keep, text).mapInArrow(count, f"{fields}, n_tokens long")
