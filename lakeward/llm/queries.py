"""The queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from lakeward.llm import (
    bpe,
    decontaminate,
    jaccard,
    language,
    linededup,
    phrases,
    pii,
    quality,
    tokencount,
    toxicity,
    trie,
    urls,
    vectors,
)

QUERIES = {
    "op1_token_counts": tokencount.op1,
    "op2_language_id": language.op2,
    "op3_line_dedup": linededup.op3,
    "op4_quality": quality.op4,
    "op5_pii": pii.op5,
    "op6_ngram_jaccard_join": jaccard.op6,
    "op7_embedding_near_dedup": vectors.op7,
    "op8_toxicity": toxicity.op8,
    "op9_benchmark_decontamination": decontaminate.op9,
    "op10_byte_bpe": bpe.op10,
    "op11_phrase_collocations": phrases.op11,
    "op12_url_filter": urls.op12,
    "op13_prefix_trie": trie.op13,
}

ORACLE = {
    "op9_benchmark_decontamination": decontaminate.OP9_SQL,
    "op11_phrase_collocations": phrases.OP11_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
