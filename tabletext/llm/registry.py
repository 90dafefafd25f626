"""Queries of this subpackage and the DuckDB statements for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from tabletext.llm import align, jaccard, media, mixing, negatives, pii, quality, repeats, sentencepiece, setsketch, topk, toxicity, warc

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_pii": pii.op4_pii,
    "op5_media": media.op5_media,
    "op6_warc": warc.op6_warc,
    "op7_sentencepiece": sentencepiece.op7_sentencepiece,
    "op8_repeats": repeats.op8_repeats,
    "op9_jaccard": jaccard.op9_jaccard,
    "op10_quality": quality.op10_quality,
    "op11_negatives": negatives.op11_negatives,
    "op12_setsketch": setsketch.op12_setsketch,
    "op13_align": align.op13_align,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op1_topk": topk.ORACLE,
    "op3_mixing": mixing.ORACLE,
    "op6_warc": warc.ORACLE,
    "op8_repeats": repeats.ORACLE,
    "op9_jaccard": jaccard.ORACLE,
    "op11_negatives": negatives.ORACLE,
    "op12_setsketch": setsketch.ORACLE,
}
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
