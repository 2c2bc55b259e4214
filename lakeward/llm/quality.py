"""Quality by hierarchical empirical Bayes: a document's evidence, with its host's and its path's posterior.

1. Evidence: a logistic regression (numpy) on counts over the whole text
   (kinds of characters, word and line lengths, repetition), learnt from a
   bounded sample of labelled rows outside the held-out fold
   (``PER_CLASS`` distinct texts of each label).  Its probability is p.
2. Grouped sums (n, sum p, sum p^2) for each path, summed up for each host
   and for all.  Between-group variance by moments gives the weight
   kappa = m (1 - m) / variance - 1 of a group's prior, at either level.
3. Posteriors of a document's site from the other documents there (its own
   p is left out of n and of the sums, so that it is not counted twice):
   host = (sum p + kappa_h * m) / (n + kappa_h); path = (sum p + kappa_p *
   host) / (n + kappa_p).  Sparse sites shrink towards their parent: a
   document alone in its path has its host's posterior, one alone in its
   host the global mean.
4. Score: logit p + logit path - logit m, as a probability.

A host is any column that says where a document comes from, a path any
column that divides a host.  Only the grouped sums are shuffled before the join; the weights come to the
driver as a handful of numbers.  Defined results: null and empty texts have
all counts zero; a null host or path is a group of its own; labels without
an id are not learnt from; ids may be of any type; if a label is
missing altogether p is the base rate; repeated rows each get their row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.llm.common import distinct_texts, held_out, python_batches, table, written

PER_CLASS = 2000
MOST_KAPPA = 1e4


def features(text: str | None) -> np.ndarray:
    """Counts over a whole text as shares and logarithms."""
    text = text or ""
    n = max(1, len(text))
    words, lines = text.split(), text.split("\n")
    letters = sum(map(len, words)) or 1
    data = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), minlength=256)
    upper, lower, digits = data[65:91].sum(), data[97:123].sum(), data[48:58].sum()
    high, blank = data[128:].sum(), data[32] + data[10] + data[9]
    sentence = data[46] + data[44]
    signs = data[33:127].sum() - upper - lower - digits - sentence
    return np.array([1.0, upper / n, digits / n, high / n, blank / n, sentence / n, signs / n, data[124] / n,
                     math.log1p(len(words)) / 5, len(set(words)) / max(1, len(words)), letters / max(1, len(words)) / 10,
                     len(set(lines)) / len(lines), math.log1p(n / len(lines)) / 5, float(not words)])


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, quality, text) to (h, quality, features)."""
    for batch in batches:
        x = [features(t).tolist() for t in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(x, pa.list_(pa.float64()))], ["h", "quality", "x"])


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """At most ``per_class`` (quality, h, doc_id) of each label, whatever the partitioning; h is the text's hash."""
    known = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out()).select("doc_id", "quality").distinct()
    rows = known.join(docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h")), "doc_id")
    # Written, so that its size is known when the texts are fetched.
    return written(distinct_texts(rows, "quality", per_class), "quality-ids")


def fit(x: np.ndarray, y: np.ndarray, steps: int = 60, l2: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method; both labels weigh the same."""
    w, weight = np.zeros(x.shape[1]), np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - l2 * w
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), g)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def evidence(docs: DataFrame, labels: DataFrame, host: str, path: str) -> DataFrame:
    """doc_id, host, path, p of every row."""
    spark = docs.sparkSession
    python_batches(spark)
    wanted = labelled_sample(docs, labels)
    # Features are counted on the executors, over whole texts as in scoring; a row comes here as a few numbers.
    rows = (docs.select("doc_id", F.xxhash64("text").alias("h"), "text").join(wanted, ["doc_id", "h"])
            .dropDuplicates(["quality", "h"]).select("h", F.col("quality").cast("int").alias("quality"), "text"))
    rows = sorted((r.h, r.quality, r.x) for r in rows.mapInArrow(_featured, "h long, quality int, x array<double>").collect())
    net = None
    if len({q for _, q, _ in rows}) == 2:
        net = fit(np.array([x for _, _, x in rows]), np.array([q for _, q, _ in rows], float))
    base = sum(q for _, q, _ in rows) / len(rows) if rows else 0.5
    shared = spark.sparkContext.broadcast((net, base))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, base = shared.value
        for batch in batches:
            p = [base if net is None else float(1 / (1 + np.exp(-np.clip(features(t) @ net, -9, 9))))
                 for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(p, pa.float64())], ["doc_id", "host", "path", "p"])

    rows = docs.select("doc_id", F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, host string, path string, p double")


def _kappa(groups: DataFrame, mean: float) -> float:
    """The prior's weight, from how much the groups' means differ beyond what their sizes explain."""
    g = groups.where("n > 1").select(F.col("n"), (F.col("s") / F.col("n")).alias("m"),
                                     ((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1)).alias("v"))
    k, between, within = g.agg(F.count("*"), F.avg(F.pow(F.col("m") - F.lit(mean), F.lit(2))), F.avg(F.col("v") / F.col("n"))).first()
    spread = max((between or 0) - (within or 0), 0.0) if k else 0.0
    return min(MOST_KAPPA, max(0.0, mean * (1 - mean) / spread - 1)) if spread else MOST_KAPPA


def site_scores(rows: DataFrame) -> DataFrame:
    """doc_id, p, host_posterior, path_posterior, score of rows (doc_id, host, path, p)."""
    rows = written(rows, "quality-evidence")
    paths = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s"), F.sum(F.col("p") * F.col("p")).alias("q"))
    paths = written(paths, "quality-paths")
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in "nsq"])
    n, s = paths.agg(F.sum("n"), F.sum("s")).first()
    mean = min(max((s or 0) / n, 1e-3), 1 - 1e-3) if n else 0.5
    top, low = _kappa(hosts, mean), _kappa(paths, mean)
    # Sums go to the rows by structs of the keys, so that the join back has an exchange of its own and AQE can split a large site.
    hosts = hosts.select(F.struct("host").alias("k"), F.col("n").alias("host_n"), F.col("s").alias("host_s"))
    paths = (paths.join(hosts, paths["host"].eqNullSafe(F.col("k.host"))).select(F.struct("host", "path").alias("k"), "n", "s", "host_n", "host_s"))
    paths = paths.select(F.col("k.host").alias("h"), F.col("k.path").alias("t"), "n", "s", "host_n", "host_s")

    def posterior(n: str, s: str, kappa: float, parent: Column) -> Column:
        others, total = F.col(n) - 1, F.col(s) - F.col("p")
        return F.when(others + F.lit(kappa) > 0, (total + F.lit(kappa) * parent) / (others + F.lit(kappa))).otherwise(parent)

    def logit(c):
        c = F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
        return F.log(c / (1 - c))

    z = logit(F.col("p")) + logit(F.col("path_posterior")) - F.lit(math.log(mean / (1 - mean)))
    return (rows.join(paths, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("t")))
            .withColumn("host_posterior", posterior("host_n", "host_s", top, F.lit(mean)))
            .withColumn("path_posterior", posterior("n", "s", low, F.col("host_posterior")))
            .select("doc_id", "p", "host_posterior", "path_posterior", (1 / (1 + F.exp(-z))).alias("score")))


def op4(spark, sf_dir):
    """The quality of all ``documents``; their source is the host, their source's language section the path."""
    found = site_scores(evidence(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "source", "lang"))
    return found.select("doc_id", held_out().alias("held_out"), "p", "host_posterior", "path_posterior", "score",
                        (F.col("score") >= 0.5).alias("keep"))
