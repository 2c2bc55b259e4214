"""Embedding near-dedup: randomised-rotation binary codes decide which pairs need exact recomputation.

Vectors are compared only within a label.  A unit vector x is rotated by a
seeded random orthogonal matrix (as many dimensions as the longest vector;
shorter ones are padded with zeros) and coded as the signs of its
coordinates, c = sign(Rx) / sqrt(d), with the stored correction factor
f = <c, Rx>.  For a pair, <c_x, Ry> / f_x estimates <x, y> without bias
over rotations, and its error is bounded: with e the part of Ry off the line
of Rx, |<c_x, Ry> / f_x - <x, y>| = |<c_x, e>| / f_x, which over rotations
stays under ``SIGMAS`` * sqrt((1 - f_x^2) / f_x^2 * (1 - <x, y>^2) / (d - 1))
(normal tail).  A pair whose estimate is further below the threshold than the
bound at the threshold is dropped; every other pair is recomputed exactly
in double precision.  SIGMAS = 6 leaves a pair at the threshold a chance of
1e-9 of being dropped.

Equal unit directions form a class first (grouped by label and components),
so a hot vector is one row.  A label's classes are dealt into blocks of
``BLOCK``; a task compares two blocks in numpy and gives out counts of links
and a spanning forest, never the pairs.  Work within a label is quadratic,
as every pair of a label is to be compared; a large label makes more tasks,
not larger ones.

Defined results: rows with a null label, or a vector that is null, empty,
zero or holds null or non-finite components, link with nothing.  Vectors
of different lengths within a label are compared as if padded with zeros.
Repeated rows each get their row and link with each other; a null vec_id is
in no result as a component unless alone.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import components, python_batches, table, told_apart, written

SIMILARITY = 0.93
BLOCK = 2048
SIGMAS = 6.0
SEED = 20240607


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix (QR of a normal one, signs fixed)."""
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def codes(unit: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their sign codes (unit length) and correction factors."""
    rotated = unit @ turn.T
    code = np.where(rotated >= 0, 1.0, -1.0) / np.sqrt(turn.shape[0])
    return rotated, code, np.einsum("ij,ij->i", code, rotated)


def candidate_pairs(left, right, similarity: float, sigmas: float = SIGMAS) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that the estimates don't rule out."""
    _, code, factor = left
    rotated = right[0]
    estimate = (code.astype(np.float32) @ rotated.T.astype(np.float32)) / factor[:, None]
    d = code.shape[1]
    error = sigmas * np.sqrt(np.maximum(1 - factor ** 2, 0) / factor ** 2 * (1 - similarity ** 2) / max(1, d - 1))
    return np.nonzero(estimate >= (similarity - error - 1e-5)[:, None])


def _links(blocks: DataFrame, dim: int, similarity: float, sigmas: float) -> DataFrame:
    """(node, linked, other): a class's count of linked rows, or (linked null) a forest link; by task."""
    def compare(rows) -> Iterator[tuple]:
        left = [r for r in rows if r[3] == r[4]]
        if not left:
            return
        own = rows[0][1] == rows[0][2]
        right = left if own else [r for r in rows if r[3] != r[4]]
        if not right:
            return
        turn = rotation(dim)

        def matrix(part):
            out = np.zeros((len(part), dim))
            for k, r in enumerate(part):
                out[k, :len(r[6])] = r[6]
            return out

        a = matrix(left)
        b = a if own else matrix(right)
        ca = codes(a, turn)
        cb = ca if own else codes(b, turn)
        copies_a, copies_b = np.array([r[7] for r in left]), np.array([r[7] for r in right])
        total_a, total_b = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for s in range(0, len(left), 256):
            i, j = candidate_pairs([x[s:s + 256] for x in ca], cb, similarity, sigmas)
            i = i + s
            if own:
                i, j = i[i != j], j[i != j]
            for k in range(0, len(i), 1 << 16):
                x, y = i[k:k + (1 << 16)], j[k:k + (1 << 16)]
                exact = np.einsum("ij,ij->i", a[x], b[y]) >= similarity
                x, y = x[exact], y[exact]
                np.add.at(total_a, x, copies_b[y])
                if not own:
                    np.add.at(total_b, y, copies_a[x])
                for u, v in zip(x, y, strict=True):
                    p, q = find(left[u][5]), find(right[v][5])
                    if p != q:
                        root[p] = q
                        yield left[u][5], None, right[v][5]
        for part, total in ((left, total_a), (right, total_b)) if not own else ((left, total_a),):
            for r, n in zip(part, total, strict=True):
                if n:
                    yield r[5], int(n), None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(out):
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)],
                                              ["node", "linked", "other"])

        task, rows = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[:3] != task:
                    if rows and (out := list(compare(rows))):
                        yield batch_of(out)
                    task, rows = row[:3], []
                rows.append(row)
        if rows and (out := list(compare(rows))):
            yield batch_of(out)

    return blocks.mapInArrow(run, "node long, linked long, other long")


def near_vectors(vectors: DataFrame, similarity: float = SIMILARITY, sigmas: float = SIGMAS) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of ``vectors`` (vec_id, embedding, label)."""
    python_batches(vectors.sparkSession)
    x = F.transform(F.col("embedding"), lambda v: v.cast("double"))
    fine = F.coalesce((F.size("embedding") > 0) & F.col("label").isNotNull() & F.forall(
        "embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
        & F.exists("embedding", lambda v: v != 0), F.lit(False))
    top = F.array_max(F.transform(x, F.abs))
    # Scaled by the largest component first, so that neither tiny nor huge vectors leave double precision.
    unit = F.transform("s", lambda v: v / F.sqrt(F.aggregate("s", F.lit(0.0), lambda a, y: a + y * y)))
    known = F.col("s").isNotNull()
    rows = (vectors.select("vec_id", "label", F.when(fine, F.transform(x, lambda v: v / top)).alias("s"))
            .select("vec_id", "label", unit.alias("unit"), F.when(known, F.xxhash64("label", unit)).alias("node"),
                    F.when(known, F.xxhash64(F.lit(1), "label", unit)).alias("proof")))
    # Two directions of one hash are told apart by the second.
    rows = told_apart(written(rows, "vectors-rows"), "node", "proof", "vectors")
    classes = rows.where("node is not null").groupBy("node", "label").agg(
        F.first("unit").alias("unit"), F.count("*").alias("copies"), F.min("vec_id").alias("low"))
    classes = written(classes, "vectors-classes")
    dim = classes.agg(F.max(F.size("unit"))).first()[0] or 1
    # Grouped by a struct of the key, so that the join back has an exchange of its own and AQE can split a large label.
    sizes = classes.groupBy(F.struct("label").alias("k")).agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("nb"))
    sizes = sizes.select(F.col("k.label").alias("label"), "nb")
    dealt = classes.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("node", F.lit(1)), F.col("nb")).cast("int"))
    tasks = (dealt.withColumn("x", F.explode(F.expr("sequence(0, nb - 1)")))
             .select("label", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"),
                     "block", F.least("block", "x").alias("first"), "node", "unit", "copies")
             .repartition("label", "i", "j").sortWithinPartitions("label", "i", "j"))
    found = written(_links(tasks, dim, similarity, sigmas), "vectors-links")
    counts = found.where("linked is not null").groupBy("node").agg(F.sum("linked").alias("linked"))
    groups = components(found.where("other is not null").select(F.col("node").alias("u"), F.col("other").alias("v")),
                        "vectors-groups").select("node", "root")
    known = (classes.select("node", "copies", "low").join(counts, "node", "left").join(groups, "node", "left")
             .select("node", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "low",
                     F.coalesce("root", "node").alias("grp")))
    best = (known.groupBy(F.struct("grp").alias("k")).agg(F.min("low").alias("component_id"))
            .select(F.col("k.grp").alias("grp"), "component_id"))
    known = known.join(best, "grp").select(F.col("node").alias("k"), "n_links", "component_id")
    return (rows.select("vec_id", "node").join(known, F.col("node") == F.col("k"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
                    F.coalesce("component_id", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def op7(spark, sf_dir):
    """Links and components of all rows of ``embeddings`` at cosine 0.93 within a label."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
