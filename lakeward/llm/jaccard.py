"""N-gram Jaccard join by MinHash banding, verified on the full n-gram sets.

A document's set is its distinct ``n``-word runs (lower-cased runs of word
characters), as 64-bit hashes; a text of fewer words, but not none, has one
run of all its words.  Documents with equal sets are copies and form a
class (a 128-bit digest in two independent halves tells them); all later
work is on classes.

1. Signature: ``bands`` x ``rows`` MinHash values; a class is dealt by its
   ``bands`` band hashes.  The defaults reach a recall of 0.9997 at 0.8
   (``recall``), and ``plan_bands`` picks counts for another target.
2. Classes that share a band hash are linked to the bucket's smallest class
   and the links' connected components are found (distributed union-find).
   A component is only a place to compare in.
3. Inside a component all classes are compared on their full sets: blocks
   of about ``BLOCK`` classes or ``BLOCK_GRAMS`` n-grams, one task per pair of blocks, sparse counting in
   numpy.  A task gives out counts of links and a spanning forest, never
   the pairs; a third of all rows in one component makes more tasks, not
   larger ones.
4. Components of the verified forests are the near-duplicate groups.

Defined results: null and empty texts and texts without words are in no
class (class_id and group_id null, no links); repeated rows each get their
row and count as copies; a null id takes part, and ids in results are the
smallest non-null one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm import common
from lakeward.llm.common import components, document_key, python_batches, step, table, written

N = 5
SIMILARITY = 0.8
BANDS, ROWS = 16, 4
BLOCK = 512
#: n-grams of a block's classes, about.
BLOCK_GRAMS = 1 << 21

_WORDS = re.compile(r"\w+").findall


def recall(similarity: float, bands: int = BANDS, rows: int = ROWS) -> float:
    """The chance that two sets of this similarity share a band."""
    return 1 - (1 - similarity ** rows) ** bands


def plan_bands(similarity: float, target: float, rows: int = ROWS) -> tuple[int, int]:
    """The fewest bands of ``rows`` rows that reach the target recall at the similarity."""
    bands = 1
    while recall(similarity, bands, rows) < target:
        bands += 1
    return bands, rows


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """Word to its row in a table of two independent 64-bit hashes; forgets everything when full."""

    def __init__(self, size: int = 300_001):
        super().__init__()
        self.rows = np.zeros((2, size), np.uint64)

    def __missing__(self, word: str) -> int:
        k = len(self)
        if k == self.rows.shape[1]:
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)], axis=1)
        self.rows[:, k] = np.frombuffer(blake2b(word.encode("utf-8", "replace"), digest_size=16).digest(), "<u8")
        self[word] = k
        return k


_words = _Words()


def word_runs(text: str | None, n: int = N, lanes: int = 2) -> np.ndarray:
    """The n-word runs of a text in order, as 64-bit hashes in one lane, or in two independent ones."""
    global _words
    found = _WORDS((text or "").lower())
    if len(_words) > 300_000:
        _words = _Words()
    index = np.fromiter(map(_words.__getitem__, found), np.int64, len(found))
    w = _words.rows[:lanes, index]
    if not w.shape[1]:
        return w
    k = min(n, w.shape[1])
    h = np.full((lanes, w.shape[1] - k + 1), k, np.uint64)
    for j in range(k):
        h = _mix(h ^ w[:, j:w.shape[1] - k + 1 + j])
    return h


def shingles(text: str | None, n: int = N) -> np.ndarray:
    """The distinct n-word runs of a text as sorted 64-bit hashes."""
    return np.unique(word_runs(text, n, 1)[0])


def digest(sets: np.ndarray) -> int:
    """64 bits of a whole set."""
    return int(np.bitwise_xor.reduce(_mix(sets + np.uint64(len(sets)))).astype(np.int64))


def _seeds(count: int) -> np.ndarray:
    return _mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def signature(sets: np.ndarray, bands: int, rows: int, chunk: int = 4096) -> np.ndarray:
    """The band hashes of one set, in bounded pieces whatever its size."""
    seeds = _seeds(bands * rows)[:, None]
    low = np.full(bands * rows, np.uint64(2 ** 64 - 1))
    for k in range(0, len(sets), chunk):
        low = np.minimum(low, ((sets[None, k:k + chunk] ^ seeds) * (seeds | np.uint64(1))).min(axis=1))
    out = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        out = _mix(out ^ low.reshape(bands, rows)[:, r])
    return out


def signatures(docs: DataFrame, n: int = N, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, th (text hash), cls (hash of the whole set, null without words), proof (another one), grams (the set's size),
    bands array<long>."""
    python_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, proof, grams, band = [], [], [], []
            for text in batch.column(2).to_pylist():
                s, other = (np.unique(lane) for lane in word_runs(text, n))
                cls.append(digest(s) if len(s) else None)
                proof.append(digest(other) if len(s) else None)
                grams.append(len(s))
                band.append(signature(s, bands, rows).astype(np.int64) if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(cls, pa.int64()), pa.array(proof, pa.int64()),
                 pa.array(grams, pa.int64()), pa.array(band, pa.list_(pa.int64()))], ["doc_id", "th", "cls", "proof", "grams", "bands"])

    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(
        run, f"doc_id {kind}, th long, cls long, proof long, grams long, bands array<long>")


def told_apart(signed: DataFrame) -> DataFrame:
    """``signed`` with a key of its own, in cls, for each (cls, proof): texts are copies if both hashes of their sets agree."""
    return common.told_apart(signed, "cls", "proof", "jaccard")


def compare_block(cls: list[int], sets: list[np.ndarray], left: np.ndarray, similarity: float,
                  columns: int = 1 << 22) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """All pairs of a block, or of two blocks, on their full sets.

    left: whether a class is in the first block (all are, in a block's own
    task).  Returns a matrix row per left class: which right classes it is
    linked to (bool), the right classes' positions, and a spanning forest.
    """
    own = bool(left.all())
    a, b = np.flatnonzero(left), np.flatnonzero(left if own else ~left)
    size = np.array([len(s) for s in sets], np.float64)
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), size.astype(int))
    shared = np.bincount(column, minlength=len(values)) > 1
    row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    common = np.zeros((len(a), len(b)))
    width = max(1, columns // max(1, len(sets)))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, [k, k + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[s:e], column[s:e] - k] = 1
        common += part[a] @ part[b].T
    alike = common >= similarity * (size[a][:, None] + size[b][None] - common) - 1e-9
    if own:
        np.fill_diagonal(alike, False)
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    forest = []
    for i, j in zip(*np.nonzero(alike), strict=True):
        x, y = find(a[i]), find(b[j])
        if x != y:
            root[x] = y
            forest.append((cls[a[i]], cls[b[j]]))
    return alike, b, forest


def _compared(blocks: DataFrame, n: int, similarity: float) -> DataFrame:
    """Rows (cls, linked, other): a class's count of linked documents, or (linked null) a forest link.

    ``blocks`` comes sorted within partitions by its task (comp, i, j); a
    task's rows are at most two blocks.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def close(rows):
            seen = {}
            for cls, copies, block, i, text in rows:
                if cls not in seen:
                    s = shingles(text, n)
                    seen[cls] = (s, copies, block == i)
            cls = list(seen)
            if len(cls) < 2:
                return
            sets, copies = [seen[c][0] for c in cls], np.array([seen[c][1] for c in cls], np.int64)
            left = np.array([seen[c][2] for c in cls])
            if not left.any():
                return
            alike, right, forest = compare_block(cls, sets, left, similarity)
            a = np.flatnonzero(left)
            for k, total in zip(a, (alike * copies[right]).sum(axis=1), strict=True):
                if total:
                    yield cls[k], int(total), None
            if not left.all():
                for k, total in zip(right, (alike * copies[a][:, None]).sum(axis=0), strict=True):
                    if total:
                        yield cls[k], int(total), None
            for x, y in forest:
                yield x, None, y

        task, rows, out = None, [], []
        for batch in batches:
            for comp, i, j, cls, copies, block, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (comp, i, j) != task:
                    out += close(rows)
                    task, rows = (comp, i, j), []
                rows.append((cls, copies, block, i, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)],
                                                 ["cls", "linked", "other"])
                out = []
        out += close(rows)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)],
                                             ["cls", "linked", "other"])

    return blocks.mapInArrow(run, "cls long, linked long, other long")


def near_duplicates(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, bands: int = BANDS,
                    rows: int = ROWS) -> DataFrame:
    """doc_id, th, cls, class_id, n_copies, n_links, group, group_id of every row of ``docs``.

    n_links counts the other documents (copies included) with a set at
    least this similar; class_id and group_id are the smallest doc_id of the
    copies and of the near-duplicate group; group is the group's inner key.
    """
    with step(docs.sparkSession) as keep:
        signed = told_apart(written(signatures(docs, n, bands, rows), "jaccard-signatures"))
        classes = signed.where("cls is not null").groupBy("cls").agg(
            F.min("doc_id").alias("class_id"), F.count("*").alias("n_copies"), F.max("grams").alias("grams"),
            F.min(F.struct("doc_id", "th")).alias("one"))
        classes = written(classes.select("cls", "class_id", "n_copies", "grams", F.col("one.doc_id").alias("rep"),
                                         F.col("one.th").alias("rep_th")), "jaccard-classes")
        banded = (signed.where("cls is not null").select("cls", F.explode("bands").alias("band")).distinct())
        first = banded.groupBy(F.struct("band").alias("k")).agg(F.min("cls").alias("low"), F.max("cls").alias("high"))
        first = first.where("low < high").select(F.col("k.band").alias("band"), "low")
        places = components(banded.join(first, "band").where("cls <> low").select(F.col("cls").alias("u"), F.col("low").alias("v")),
                            "jaccard-places")
        placed = places.join(classes, places["node"] == classes["cls"])
        # Grouped by a struct of the key, so that the join back has an exchange of its own and AQE can split a large component.
        sizes = placed.groupBy(F.struct("root").alias("k")).agg(F.ceil(F.greatest(
            F.count("*") / F.lit(BLOCK), F.sum("grams") / F.lit(BLOCK_GRAMS))).cast("int").alias("nb"))
        sizes = sizes.select(F.col("k.root").alias("root"), "nb")
        dealt = written(placed.join(sizes, "root").select(
            "root", "cls", "n_copies", "rep", "rep_th", "nb",
            F.pmod(F.xxhash64("cls", F.lit(1)), F.col("nb")).cast("int").alias("block")), "jaccard-dealt")
        texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), "text")
        # By shuffle whatever the number of classes, so that disk and time grow with the input at every size.
        dealt = texts.join(dealt.hint("merge"), dealt["rep"].eqNullSafe(F.col("_id")) & (dealt["rep_th"] == F.col("_th")))
        tasks = (dealt.select("root", "cls", "n_copies", "block", "text", F.explode(F.expr("sequence(0, nb - 1)")).alias("x"))
                 .select("root", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "cls", "n_copies",
                         "block", "text")
                 .repartition("root", "i", "j").sortWithinPartitions("root", "i", "j"))
        found = written(_compared(tasks, n, similarity), "jaccard-links")
        links = found.where("linked is not null").groupBy("cls").agg(F.sum("linked").alias("linked"))
        groups = components(found.where("other is not null").select(F.col("cls").alias("u"), F.col("other").alias("v")),
                            "jaccard-groups")
        classes = written(classes.join(links, "cls", "left")
                          .join(groups.select(F.col("node").alias("cls"), F.col("root").alias("grp")), "cls", "left")
                          .select("cls", "class_id", "n_copies", F.coalesce("linked", F.lit(0)).alias("linked"),
                                  F.coalesce("grp", "cls").alias("grp")), "jaccard-grouped")
        first = classes.groupBy(F.struct("grp").alias("k")).agg(F.min("class_id").alias("group_id")).select(F.col("k.grp").alias("grp"), "group_id")
        classes = classes.join(first, "grp").select(
            F.col("cls").alias("c"), "class_id", "n_copies", (F.col("linked") + F.col("n_copies") - 1).alias("n_links"),
            F.col("grp").alias("group"), "group_id")
        return keep(written(
            signed.select("doc_id", "th", "cls").join(classes, F.col("cls") == F.col("c"), "left")
            .select("doc_id", "th", "cls", "class_id", F.coalesce("n_copies", F.lit(1)).alias("n_copies"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"), "group", "group_id"), "jaccard-found"))


def one_of_each(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id.

    Documents without words stay, and so does every column.  Rows equal in
    doc_id and text come back as one row.
    """
    found = near_duplicates(docs, **how).withColumn(
        "_key", F.concat_ws("|", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("th").cast("string")))
    best = (found.where("cls is not null").groupBy("group").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "_key")).alias("b")).select("b._key"))
    stay = best.union(found.where("cls is null").select("_key")).distinct()
    kept = docs.withColumn("_key", document_key()).join(stay, "_key", "left_semi")
    return kept.dropDuplicates(["_key"]).select(docs.columns)


def op6(spark, sf_dir):
    """Near-duplicates of all ``documents`` on five-word runs at 0.8: a row per document, its class and links."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_copies", "n_links", "group_id")
