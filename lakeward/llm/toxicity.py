"""Toxicity by a convolutional text classifier (numpy): hashed word embeddings, several widths, max pooling.

Words are lower-cased runs of word characters; a word's embedding is the
sum of the hashed embeddings of the word and of its first characters
(``PREFIXES``), so that unseen forms of a known stem are near it.  A document's features are each filter's maximum over all its
words, so one passage anywhere in a long text counts.  The embeddings'
first dimension starts at the word's shrunken log-odds in the training
rows (the rest at random), then everything is trained.

Training rows are bounded: ``PER_CLASS`` distinct texts of each label from
outside the held-out fold, each as the windows of its whole text; if these
are more than ``SAMPLE_WINDOWS`` for a label, fewer texts, never a part of one
(but ``MIN_TEXTS`` at least).  The net
is some hundred KB and is broadcast.  Scores never see labels, lang, source
or doc_id.  A threshold for each language is then set on the scores of all
labelled rows outside the fold (``thresholds``; the training rows are among
them): the least score at which the language's precision is at least
``PRECISION``; languages with few toxic rows in the table take the global one.

Defined results: null and empty texts get the net's score for no words; if
a label is missing altogether every score is the base rate.  Repeated rows
each get their row; null ids count as held out.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeward.llm.common import distinct_texts, held_out, python_batches, table, written
from lakeward.llm.convnet import ConvNet, cut

BUCKETS = 1 << 15
PREFIXES = (3, 4, 6)
WINDOW = 128
PER_CLASS = 2000
SAMPLE_WINDOWS = 100_000
MIN_TEXTS = 20
PRECISION = 0.9
MIN_TOXIC = 20
BINS = 4096

_WORDS = re.compile(r"\w+").findall


class _Seen(dict):
    """Word to its row in a table of hashed ids; forgets everything when full."""

    def __init__(self, size: int = 200_000):
        super().__init__()
        self.rows = np.zeros((size, 1 + len(PREFIXES)), np.int32)

    def __missing__(self, word: str) -> int:
        forms = [word] + [f"{n}^{word[:n]}" for n in PREFIXES]
        k = len(self)
        if k == len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[k] = [1 + zlib.crc32(x.encode("utf-8", "replace")) % (BUCKETS - 1) for x in forms]
        self[word] = k
        return k


_seen = _Seen()


def symbols(text: str | None) -> np.ndarray:
    """(words, 1 + len(PREFIXES)): hashed ids from 1 to BUCKETS - 1."""
    global _seen
    if len(_seen) > 200_000:
        _seen = _Seen()
    found = _WORDS((text or "").lower())
    index = np.fromiter(map(_seen.__getitem__, found), np.int64, len(found))
    return _seen.rows[index]


def known(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels outside the held-out fold, once each."""
    return labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out()).select("doc_id", "toxic").distinct()


def _windowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, toxic, text) to (h, toxic, n windows, the windows' ids as bytes)."""
    for batch in batches:
        found = [cut(symbols(t), WINDOW).astype("<u2") for t in batch.column(2).to_pylist()]
        # The net takes maxima over windows: equal ones count once.
        found = [np.unique(w, axis=0) for w in found]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array([len(w) for w in found], pa.int64()),
                                          pa.array([w.tobytes() for w in found], pa.binary())], ["h", "toxic", "n", "windows"])


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> list[tuple[int, np.ndarray]]:
    """At most ``per_class`` (toxic, windows of the whole text) of each label, whatever the partitioning."""
    python_batches(docs.sparkSession)
    text = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    # First the ids of the sample, then their texts: the shuffles carry no text but the sample's.
    # Written, so that its size is known when the texts are fetched.
    wanted = written(distinct_texts(known(labels).join(text.select("doc_id", "h"), "doc_id"), "toxic", per_class), "toxicity-ids")
    rows = text.join(wanted.select("doc_id", "h", "toxic"), ["doc_id", "h"]).dropDuplicates(["toxic", "h"]).select(
        "h", F.col("toxic").cast("int").alias("toxic"), "text")
    rows = written(rows.mapInArrow(_windowed, "h long, toxic int, n long, windows binary"), "toxicity-sample")
    ahead = Window.partitionBy("toxic").orderBy("h")
    taken = (rows.select("h", "toxic", F.sum("n").over(ahead).alias("sum"), F.row_number().over(ahead).alias("place"))
             .where((F.col("sum") <= SAMPLE_WINDOWS) | (F.col("place") <= MIN_TEXTS)).select("h", "toxic"))
    rows = rows.join(F.broadcast(taken), ["h", "toxic"]).select("toxic", "h", "windows").collect()
    shape = (-1, WINDOW, 1 + len(PREFIXES))
    return [(r.toxic, np.frombuffer(r.windows, "<u2").reshape(shape)) for r in sorted(rows, key=lambda r: (r.toxic, r.h))]


def train(sample: list[tuple[int, np.ndarray]]) -> ConvNet | None:
    y = np.array([t for t, _ in sample], np.int64)
    if len(set(y.tolist())) < 2:
        return None
    df = np.zeros((2, BUCKETS))
    for (_, s), t in zip(sample, y, strict=True):
        df[t, np.unique(s)] += 1
    df[:, 0] = 0
    n = np.bincount(y, minlength=2)
    odds = np.log((df[1] + 1) / (n[1] + 2)) - np.log((df[0] + 1) / (n[0] + 2))
    net = ConvNet(BUCKETS, 2, dim=8, widths=(1, 2, 3), filters=8)
    net.p["emb"] *= 0.1
    net.p["emb"][:, 0] = odds / np.sqrt(1 / (df[1] + 1) + 1 / (df[0] + 1)) / 5
    net.p["emb"][0] = 0
    weights = (1 / n)[y] * np.where(y == 1, 0.5, 1.0)
    return net.fit([s for _, s in sample], y, weights.astype(np.float32), epochs=8, batch=32, rate=0.005, decay=1e-3)


def score_texts(net: ConvNet | None, base: float, texts: list[str | None], chunk: int = 2048) -> np.ndarray:
    """The probability of label 1 for each text; windows are pooled in chunks, then over each text."""
    if net is None:
        return np.full(len(texts), base)
    top = np.full((len(texts), net.mask.shape[1]), -np.inf, np.float32)
    parts, owners, held = [], [], 0

    def flush():
        if parts:
            np.maximum.at(top, np.concatenate(owners), net.pooled(np.concatenate(parts)))
            parts.clear()
            owners.clear()

    for i, text in enumerate(texts):
        windows = cut(symbols(text), WINDOW)
        for k in range(0, len(windows), chunk):
            parts.append(windows[k:k + chunk])
            owners.append(np.full(len(parts[-1]), i))
            held += len(parts[-1])
            if held >= chunk:
                flush()
                held = 0
    flush()
    return net.probabilities(top)[:, 1].astype(float) if texts else np.zeros(0)


def thresholds(labelled: DataFrame) -> DataFrame:
    """(lang, threshold) of rows (lang, score, toxic): the least score from which on precision is at least PRECISION.

    lang "" is for all rows; other languages are here if they have
    ``MIN_TOXIC`` toxic rows.  Exact, and no task gets a whole language:
    equal scores are summed first, then scores are ranked within ``BINS``
    bins on top of what the higher bins hold.
    """
    langs = F.when(F.coalesce("lang", F.lit("")) == "", F.array(F.lit(""))).otherwise(F.array(F.lit(""), "lang"))
    ties = (labelled.select(F.explode(langs).alias("lang"), "score", "toxic").groupBy("lang", "score")
            .agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
            .withColumn("bin", F.floor(F.col("score") * BINS)))
    ties = written(ties, "toxicity-ties")
    higher = Window.partitionBy("lang").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    bins = ties.groupBy("lang", "bin").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    bins = bins.select(F.struct("lang", "bin").alias("k"), F.coalesce(F.sum("n").over(higher), F.lit(0)).alias("over_n"),
                       F.coalesce(F.sum("t").over(higher), F.lit(0)).alias("over_t"))
    within = Window.partitionBy("lang", "bin").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = ties.join(bins, (F.col("lang") == F.col("k.lang")) & (F.col("bin") == F.col("k.bin")))
    ranked = ranked.select("lang", "score", "t", (F.col("over_n") + F.sum("n").over(within)).alias("n_from"),
                           (F.col("over_t") + F.sum("t").over(within)).alias("t_from"))
    precise = F.min(F.when(F.col("t_from") / F.col("n_from") >= PRECISION, F.col("score")))
    return (ranked.groupBy("lang").agg(F.coalesce(precise, F.lit(1.0)).alias("threshold"), F.sum("t").alias("toxic"))
            .where((F.col("lang") == "") | (F.col("toxic") >= MIN_TOXIC)).select("lang", "threshold"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``; then the language's threshold and flagged."""
    spark = docs.sparkSession
    python_batches(spark)
    sample = labelled_sample(docs, labels)
    net = train(sample)
    base = sum(x[0] for x in sample) / max(1, len(sample))
    shared = spark.sparkContext.broadcast((net, base))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, base = shared.value
        for batch in batches:
            score = score_texts(net, base, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score, pa.float64())], ["doc_id", "lang", "score"])

    scored = docs.select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    scored = written(scored.mapInArrow(run, f"doc_id {kind}, lang string, score double"), "toxicity-scores")
    limits = written(thresholds(scored.join(known(labels), "doc_id")), "toxicity-thresholds")
    of_all = limits.where("lang = ''").first()
    limits = F.broadcast(limits.where("lang <> ''").select(F.col("lang").alias("_lang"), F.col("threshold").alias("_own")))
    limit = F.coalesce("_own", F.lit(of_all.threshold if of_all else 1.0))
    return (scored.join(limits, F.col("lang") == F.col("_lang"), "left")
            .select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"),
                    limit.alias("threshold"), (F.col("score") >= limit).alias("flagged")))


def op8(spark, sf_dir):
    """The toxicity of every whole text of ``documents``, learnt from ``labels`` outside the held-out fold."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
