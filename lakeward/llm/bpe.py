"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token's bytes are a doubly linked list of positions.  Each merge rank
has a bucket of the positions whose pair has that rank; a three-level
bitmap of 64-bit words marks the ranks with a bucket, and find-first-set
(lowest set bit, level by level) gives the next rank in constant time.
Merges push the two new neighbour pairs and leave old entries behind;
stale entries are skipped when they are popped.  A pre-token of n bytes
takes O(n log n) steps whatever its length (the log from keeping a
bucket's positions leftmost first).

Ranks come from a rank file whose path is a parameter; the driver reads it
(bounded, some MB) and broadcasts it.  Defined results: a null text is
empty; an empty text has no ids and empty bytes; repeated rows each get
their row.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator
from heapq import heappop, heappush
from struct import pack

import pyarrow as pa
from pyspark.sql import DataFrame

from lakeward.llm.common import python_batches, table

#: Entries of one generation of a worker's cache of encoded pre-tokens (two generations are held).
CACHE = 500_000
#: Characters of the longest pre-token that is kept there.
KEPT = 128


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: per line a token in base64 and its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines) if a}


class RankQueue:
    """Positions by merge rank; empty again after every pre-token, so one queue serves a worker."""

    def __init__(self, n_ranks: int):
        self.low = [0] * (n_ranks // 64 + 1)
        self.mid = [0] * (n_ranks // 4096 + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def first(self) -> int:
        """The lowest rank that has a bucket, or -1."""
        top = self.top
        if not top:
            return -1
        a = (top & -top).bit_length() - 1
        word = self.mid[a]
        b = a << 6 | (word & -word).bit_length() - 1
        word = self.low[b]
        return b << 6 | (word & -word).bit_length() - 1

    def drop(self, rank: int) -> None:
        """Forget an emptied bucket."""
        del self.buckets[rank]
        b = rank >> 6
        self.low[b] &= ~(1 << (rank & 63))
        if not self.low[b]:
            a = b >> 6
            self.mid[a] &= ~(1 << (b & 63))
            if not self.mid[a]:
                self.top &= ~(1 << a)


def merge_pieces(piece: bytes, rank_of, queue: RankQueue) -> list[bytes]:
    """The tokens of one pre-token, as byte strings."""
    n = len(piece)
    after, before, pair = list(range(1, n + 2)), list(range(-1, n)), [-1] * n
    for i in range(n - 1):
        rank = rank_of(piece[i:i + 2])
        if rank is not None:
            pair[i] = rank
            queue.push(rank, i)
    while (rank := queue.first()) >= 0:
        bucket = queue.buckets[rank]
        i = heappop(bucket)
        if not bucket:
            queue.drop(rank)
        if pair[i] != rank:  # stale
            continue
        j = after[i]
        end = after[j]
        pair[j] = -1
        after[i] = end
        if end < n:
            before[end] = i
            new = rank_of(piece[i:after[end]])
            if new is None:
                pair[i] = -1
            else:
                pair[i] = new
                queue.push(new, i)
        else:
            pair[i] = -1
        h = before[i]
        if h >= 0:
            new = rank_of(piece[h:end])
            if new is None:
                pair[h] = -1
            elif new != pair[h]:
                pair[h] = new
                queue.push(new, h)
    out, i = [], 0
    while i < n:
        out.append(piece[i:after[i]])
        i = after[i]
    return out


class Coder:
    """Encodes and decodes whole texts; pre-tokens seen lately are looked up."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = CACHE):
        import regex

        self.split = regex.compile(pattern).findall
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.limit = cache
        outer = self

        class Lately(dict):
            """Pre-token to packed ids, in two generations."""

            old: dict = {}

            def __missing__(self, token: str) -> bytes:
                ids = self.old.get(token)
                if ids is None:
                    ids = outer.encode_token(token.encode("utf-8", "surrogatepass"))
                # A long pre-token hardly comes again, and would fill the cache.
                if len(token) <= KEPT:
                    self[token] = ids
                return ids

        self.lately = Lately()

    def encode_token(self, piece: bytes) -> bytes:
        rank = self.ranks.get(piece)
        if rank is not None:
            return pack("<I", rank)
        parts = merge_pieces(piece, self.ranks.get, self.queue)
        return pack(f"<{len(parts)}I", *map(self.ranks.__getitem__, parts))

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        if len(self.lately) > self.limit:
            self.lately.old = dict(self.lately)
            self.lately.clear()
        return b"".join(map(self.lately.__getitem__, self.split(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_WORKER: dict[str, Coder] = {}


def worker_coder(call: str, ranks, pattern: str) -> Coder:
    """The coder of one call in this worker: later tasks in it find the cache warm."""
    if call not in _WORKER:
        _WORKER.clear()
        _WORKER[call] = Coder(ranks.value, pattern)
    return _WORKER[call]


def default_ranks() -> tuple[str, str]:
    """Path and pattern of the public tokenizer that the query names."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _per_batch(docs: DataFrame, ranks_path: str | None, pattern: str | None, schema: str, make, columns) -> DataFrame:
    spark = docs.sparkSession
    python_batches(spark)
    if ranks_path is None or pattern is None:
        ranks_path, pattern = default_ranks()
    shared = spark.sparkContext.broadcast(read_ranks(ranks_path))

    call = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = worker_coder(call, shared, pattern)
        for batch in batches:
            yield make(coder, batch)

    return docs.select(*columns).mapInArrow(run, schema)


def encode(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids array<int>: the token ids of every text."""
    def make(coder, batch):
        import numpy as np

        ids = [np.frombuffer(coder.encode(t or ""), "<u4").astype(np.int32) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _per_batch(docs, ranks_path, pattern, f"doc_id {kind}, ids array<int>", make, ["doc_id", "text"])


def decode(encoded: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, bytes: the bytes that the ids stand for."""
    def make(coder, batch):
        data = [coder.decode(x or ()) for x in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], ["doc_id", "bytes"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return _per_batch(encoded, ranks_path, pattern, f"doc_id {kind}, bytes binary", make, ["doc_id", "ids"])


def digests(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded, then decoded from the ids, in one pass."""
    def make(coder, batch):
        n, ids_sha, text_sha = [], [], []
        for text in batch.column(1).to_pylist():
            ids = coder.encode(text or "")
            n.append(len(ids) // 4)
            ids_sha.append(hashlib.sha256(ids).hexdigest())
            text_sha.append(hashlib.sha256(coder.decode(memoryview(ids).cast("I"))).hexdigest())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                                          ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _per_batch(docs, ranks_path, pattern,
                      f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string", make, ["doc_id", "text"])


def op10(spark, sf_dir):
    """Every whole text of ``documents`` encoded and decoded; the digests of both."""
    return digests(table(spark, sf_dir, "documents"))
