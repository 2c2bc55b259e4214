"""The corpus pipeline: five stages, each one operator of ``lakeward.llm`` over all that the one before kept.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet
and reread as the next one's docs.  All but the last return the columns of
documents; the last returns the digests of the encoded and decoded texts.
"""

from __future__ import annotations

from lakeward.llm import bpe, decontaminate, jaccard, language, linededup
from lakeward.llm.common import step, table, written
from lakeward.session import discard, scratch


def language_id(spark, docs, sf_dir):
    """Documents whose language the byte network identifies."""
    return language.identified(docs)


def line_dedup(spark, docs, sf_dir):
    """Texts without lines that stand, equal or similar, in an earlier place."""
    return linededup.without_repeats(docs)


def ngram_jaccard(spark, docs, sf_dir):
    """One document of each near-duplicate group."""
    return jaccard.one_of_each(docs)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents without a window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def byte_bpe(spark, docs, sf_dir):
    """Token counts and digests of the ids and of the bytes decoded from them."""
    return bpe.digests(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("benchmark_decontamination", benchmark_decontamination),
    ("byte_bpe", byte_bpe),
]

#: Trained scores, MinHash and BPE have no SQL form; tests/llm hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over the ``documents`` of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    with scratch(spark) as keep:
        for name, stage in STAGES[:-1]:
            before = docs
            with step(spark) as of_stage:
                docs = of_stage(written(stage(spark, before, sf_dir), f"pipeline-{name}"))
            # The next stage reads what this one wrote: its own input is finished.
            discard(before)
        keep(docs)
    return STAGES[-1][1](spark, docs, sf_dir)
