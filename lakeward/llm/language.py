"""Language identification by a byte convolutional network (numpy) over fixed-length windows.

The network is trained on the driver on a bounded sample of labelled rows
(``PER_LANGUAGE`` distinct texts of each language, ``SAMPLE_WINDOWS`` windows of
each, picked by their hash over the whole text; of more than ``MAX_LANGUAGES`` languages those with the most texts in it, then by name) from outside the held-out fold; it is
some KB and is broadcast.  Prediction reads the lower-cased bytes of each
whole text as windows of ``WINDOW`` bytes; a document's probabilities are
the windows' means, weighted by their bytes.

Defined results: a null text or one without a letter is ``und`` with score
0; so is every text if no row is labelled.  Repeated rows each get their
row; null ids count as held out; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeward.llm.common import distinct_texts, held_out, python_batches, table, written
from lakeward.llm.convnet import ConvNet, cut

WINDOW = 128
PER_LANGUAGE = 400
SAMPLE_WINDOWS = 8
#: Texts to train on in all: with many languages each gets fewer, but every language one at least.
SAMPLE = 80_000
#: A document whose best language is less likely than this has no identified language (``identified``).
MIN_SCORE = 0.3


def _picked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, h, text) to (lang, h, windows): some windows of the whole text by their hash, as bytes."""
    for batch in batches:
        out = []
        for text in batch.column(2).to_pylist():
            full = {w.tobytes() for w in cut(symbols(text), WINDOW)}
            out.append(b"".join(sorted(full, key=lambda w: (zlib.crc32(w), w))[:SAMPLE_WINDOWS]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(out, pa.binary())], ["lang", "h", "windows"])


def labelled_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> list[tuple[str, bytes]]:
    """At most ``per_language`` (lang, windows) of each language, the same rows whatever the partitioning."""
    python_batches(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").where(~held_out()).select("lang", F.xxhash64("text").alias("h"), "doc_id", "text")
    languages = rows.select(F.count_distinct("lang")).first()[0]
    per_language = min(per_language, max(1, SAMPLE // max(1, languages)))
    # Written, so that its size is known when the texts are fetched.
    ids = written(distinct_texts(rows, "lang", per_language), "language-sample")
    texts = rows.join(ids, ["lang", "h", "doc_id"]).dropDuplicates(["lang", "h"])
    found = texts.select("lang", "h", "text").mapInArrow(_picked, "lang string, h long, windows binary").collect()
    return [(r.lang, bytes(r.windows)) for r in sorted(found, key=lambda r: (r.lang, r.h))]


def symbols(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)[:, None]


def train(sample: list[tuple[str, bytes]]) -> tuple[ConvNet | None, list[str]]:
    languages = sorted({lang for lang, _ in sample})
    docs, labels = [], []
    for lang, windows in sample:
        for window in np.frombuffer(windows, np.uint8).reshape(-1, WINDOW, 1):
            if np.count_nonzero(window) >= 16:
                docs.append(window[None])
                labels.append(languages.index(lang))
    if not docs:
        return None, languages
    y = np.array(labels)
    weights = 1 / np.bincount(y, minlength=len(languages))[y]
    return ConvNet(256, len(languages)).fit(docs, y, weights.astype(np.float32), batch=64), languages


def score_texts(net: ConvNet | None, languages: list[str], texts: list[str | None], chunk: int = 2048) -> list[tuple[str, float]]:
    """(lang_pred, score) of each text; windows are scored in chunks across texts."""
    import regex

    letter = regex.compile(r"\p{L}").search
    live = [i for i, t in enumerate(texts) if net is not None and t and letter(t)]
    total = np.zeros((len(texts), max(1, len(languages))))
    mass = np.zeros(len(texts))
    parts, owners, held = [], [], 0

    def flush():
        if parts:
            windows, owner = np.concatenate(parts), np.concatenate(owners)
            weight = np.count_nonzero(windows[:, :, 0], axis=1).astype(float)
            prob = net.probabilities(net.pooled(windows))
            np.add.at(total, owner, prob * weight[:, None])
            np.add.at(mass, owner, weight)
            parts.clear()
            owners.clear()

    for i in live:
        windows = cut(symbols(texts[i]), WINDOW)
        for k in range(0, len(windows), chunk):
            parts.append(windows[k:k + chunk])
            owners.append(np.full(len(parts[-1]), i))
            held += len(parts[-1])
            if held >= chunk:
                flush()
                held = 0
    flush()
    out = [("und", 0.0)] * len(texts)
    for i in live:
        p = total[i] / max(mass[i], 1)
        out[i] = (languages[int(p.argmax())], float(min(1.0, p.max())))
    return out


def predict(docs: DataFrame, net: ConvNet | None, languages: list[str], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every row of ``docs``, then _lang and _score; one pass, no shuffle."""
    spark = docs.sparkSession
    python_batches(spark)
    shared = spark.sparkContext.broadcast((net, languages))
    rows = docs.select(F.col("text").alias("_text"), *keep)
    schema = T.StructType([*rows.schema.fields[1:], T.StructField("_lang", T.StringType()),
                           T.StructField("_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, languages = shared.value
        for batch in batches:
            found = score_texts(net, languages, batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([x for x, _ in found], pa.string()),
                 pa.array([x for _, x in found], pa.float64())], schema.names)

    return rows.mapInArrow(run, schema)


def languages_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``docs``, learnt from its own labelled rows."""
    net, languages = train(labelled_sample(docs))
    return predict(docs, net, languages, ["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def identified(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """``docs`` without the rows whose language is ``und`` or less likely than ``min_score``; all columns stay."""
    net, languages = train(labelled_sample(docs))
    found = predict(docs, net, languages, docs.columns)
    return found.where((F.col("_lang") != "und") & (F.col("_score") >= min_score)).select(docs.columns)


def op2(spark, sf_dir):
    """The language of every whole text of ``documents``."""
    return languages_of(table(spark, sf_dir, "documents"))
