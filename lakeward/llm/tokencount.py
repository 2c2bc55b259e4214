"""Token counts that follow edits: pre-token segment trees, re-encoding only what an edit touches.

A document's pre-tokens are grouped into leaves of ``LEAF``; a leaf holds its
characters and tokens, and a binary tree over the leaves holds their sums.
The tree is kept with the text as two arrays (heap order, root at 1), so it
can be written and edited later.  An edit replaces text[start:end]:

* it descends by characters to the leaf that holds ``start - CONTEXT`` (a
  pre-token's end depends on no more than two characters beyond it, so what
  ends earlier stands),
* re-splits from that leaf's start until a new pre-token boundary meets an
  old leaf boundary behind the edit (from there on the split has no memory
  of what was before),
* puts the new sums into the leaves and updates their paths to the root.

Counting needs no ids: each pre-token's count is that of the installed
tokenizer, cached.  Defined results: a null text is empty (no tokens, one
empty leaf); edits of one document must not overlap and are offsets into
the text before any of them; ends beyond the text are cut; repeated rows
each get their row.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lakeward.llm.bpe import default_ranks, read_ranks
from lakeward.llm.common import python_batches, table

LEAF = 64
CONTEXT = 3
EDITS = "array<struct<start:int,end:int,text:string>>"


class Counter:
    """Splits into pre-tokens and counts the tokens of each."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, cache: int = 600_000):
        import regex
        import tiktoken

        self.split = regex.compile(pattern)
        coder = tiktoken.Encoding("counts", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.limit = cache

        class Counts(dict):
            def __missing__(self, token):
                n = self[token] = len(coder.encode_ordinary(token))
                return n

        self.counts = Counts()

    def sizes(self, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.counts) > self.limit:
            self.counts.clear()
        return (np.fromiter(map(len, found), np.int32, len(found)),
                np.fromiter(map(self.counts.__getitem__, found), np.int32, len(found)))


class Tree:
    """Sums of characters and tokens over a power of two of leaves, in heap order."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens, self.n = chars, tokens, len(chars) // 2

    @classmethod
    def build(cls, counter: Counter, text: str) -> Tree:
        found = counter.split.findall(text)
        n = 1
        while n * LEAF < len(found):
            n *= 2
        sums = []
        for values in counter.sizes(found):
            tree = np.zeros(2 * n, np.int32)
            if len(found):
                part = np.add.reduceat(values, np.arange(0, len(found), LEAF))
                tree[n:n + len(part)] = part
            level = n
            while level > 1:
                tree[level // 2:level] = tree[level:2 * level].reshape(-1, 2).sum(axis=1)
                level //= 2
            sums.append(tree)
        return cls(*sums)

    def leaf_at(self, char: int) -> tuple[int, int]:
        """The leaf that holds this character (the last that has any, beyond the end) and where it starts."""
        node, start = 1, 0
        while node < self.n:
            node *= 2
            if char >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - self.n, int(start)

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.n
        for tree, value in ((self.chars, chars), (self.tokens, tokens)):
            change, at = value - tree[node], node
            while at:
                tree[at] += change
                at //= 2

    def edit(self, counter: Counter, text: str, start: int, end: int, new: str) -> tuple[str, int]:
        """The edited text and how many pre-tokens were encoded again."""
        start, end = min(start, len(text)), min(max(start, end), len(text))
        after = text[:start] + new + text[end:]
        first, at = self.leaf_at(max(0, start - CONTEXT))
        while first and at > max(0, start - CONTEXT):
            first -= 1
            at -= int(self.chars[first + self.n])
        shift = len(after) - len(text)
        last, edge = first, at + int(self.chars[first + self.n])
        found, place = [], at
        for m in counter.split.finditer(after, at):
            found.append(m[0])
            place = m.end()
            while edge + shift < place and last < self.n - 1:
                last += 1
                edge += int(self.chars[last + self.n])
            if edge >= end and edge + shift == place:
                break
        if place >= len(after):
            last = self.n - 1
        chars, tokens = counter.sizes(found)
        for leaf in range(first + 1, last + 1):
            if self.chars[leaf + self.n]:
                self.put(leaf, 0, 0)
        self.put(first, int(chars.sum()), int(tokens.sum()))
        return after, len(found)


_WORKER: dict[str, Counter] = {}


def _counter(call: str, ranks, pattern: str) -> Counter:
    if call not in _WORKER:
        _WORKER.clear()
        _WORKER[call] = Counter(ranks.value, pattern)
    return _WORKER[call]


def _mapped(rows: DataFrame, schema: str, names: list[str], make, ranks_path, pattern) -> DataFrame:
    spark = rows.sparkSession
    python_batches(spark)
    if ranks_path is None or pattern is None:
        ranks_path, pattern = default_ranks()
    shared, call = spark.sparkContext.broadcast(read_ranks(ranks_path)), uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(call, shared, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays(make(counter, batch), names)

    return rows.mapInArrow(run, schema)


def build_trees(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, text, chars, tokens: every text with its segment tree (tokens[1] is the document's count)."""
    def make(counter, batch):
        trees = [Tree.build(counter, t or "") for t in batch.column(1).to_pylist()]
        return [batch.column(0), batch.column(1), pa.array([t.chars for t in trees], pa.list_(pa.int32())),
                pa.array([t.tokens for t in trees], pa.list_(pa.int32()))]

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _mapped(docs.select("doc_id", "text"), f"doc_id {kind}, text string, chars array<int>, tokens array<int>",
                   ["doc_id", "text", "chars", "tokens"], make, ranks_path, pattern)


def apply_edits(trees: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``trees`` (with a column edits, see ``EDITS``) after their edits, with n_edits, n_before, n_after, n_encoded.

    n_encoded counts the pre-tokens that were encoded again.
    """
    def make(counter, batch):
        out = [[], [], [], [], [], [], []]
        for text, chars, tokens, edits in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
            tree, text, again = Tree(np.array(chars, np.int32), np.array(tokens, np.int32)), text or "", 0
            before = int(tree.tokens[1])
            for e in sorted(edits or [], key=lambda e: -e["start"]):
                text, n = tree.edit(counter, text, e["start"], e["end"], e["text"] or "")
                again += n
            for column, value in zip(out, (text, tree.chars, tree.tokens, len(edits or []), before, int(tree.tokens[1]), again),
                                     strict=True):
                column.append(value)
        kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), *[pa.int64()] * 4]
        return [batch.column(0), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]

    kind = trees.schema["doc_id"].dataType.simpleString()
    return _mapped(trees.select("doc_id", "text", "chars", "tokens", "edits"),
                   f"doc_id {kind}, text string, chars array<int>, tokens array<int>, n_edits long, n_before long, "
                   "n_after long, n_encoded long",
                   ["doc_id", "text", "chars", "tokens", "n_edits", "n_before", "n_after", "n_encoded"], make, ranks_path, pattern)


def masking_edits(trees: DataFrame) -> DataFrame:
    """``trees`` with the edits that a masking of digit runs and mail addresses would make."""
    wanted = re.compile(r"[^\s@]+@[^\s@]+|[0-9]{4,}")
    kind = trees.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            edits = [[{"start": m.start(), "end": m.end(), "text": "<mail>" if "@" in m[0] else "<number>"}
                      for m in wanted.finditer(t or "")] for t in batch.column(1).to_pylist()]
            where = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("text", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, where)],
                                             ["doc_id", "text", "chars", "tokens", "edits"])

    return trees.mapInArrow(run, f"doc_id {kind}, text string, chars array<int>, tokens array<int>, edits {EDITS}")


def op1(spark, sf_dir):
    """Token counts of all ``documents`` before and after the edits that mask their numbers and addresses."""
    trees = build_trees(table(spark, sf_dir, "documents"))
    return apply_edits(masking_edits(trees)).select("doc_id", "n_before", "n_edits", "n_after", "n_encoded")
