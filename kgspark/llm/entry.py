"""Queries of this subpackage, and their SQL where SQL can express them."""

import corpus_pipeline
from kgspark.llm import ann, chat, fingerprints, jaccard, mixing, packing, pii, quality, spelling, suffixes, urls, warc, whitening

QUERIES = {
    "op1_mixing": mixing.query,
    "op2_url_filters": urls.query,
    "op3_chat_formatting": chat.query,
    "op4_best_fit_packing": packing.query,
    "op5_quality_rules": quality.query,
    "op6_ngram_jaccard_join": jaccard.query,
    "op7_warc": warc.query,
    "op8_suffix_array_dedup": suffixes.query,
    "op9_pii": pii.query,
    "pipeline": corpus_pipeline.run,
    "op10_nearest_neighbours": ann.query,
    "op11_spelling_variants": spelling.query,
    "op12_fingerprints": fingerprints.query,
    "op13_whitening": whitening.query,
}
ORACLES = {"op3_chat_formatting": chat.ORACLE, "op5_quality_rules": quality.ORACLE, "op7_warc": warc.ORACLE}
