"""Queries of the training-data operators with their SQL, where SQL can express them."""

from __future__ import annotations

from cipherlode.llm import exact, fingerprints, jaccard, langid, lm, media, mixing, periods, substrings, tokens, toxicity, trie, urls


def queries():
    return {
        "op1_bpe": tokens.query,
        "op2_mixing": mixing.query,
        "op3_ngram_join": jaccard.query,
        "op4_fingerprints": fingerprints.query,
        "op5_media": media.query,
        "op6_lm": lm.query,
        "op7_toxicity": toxicity.query,
        "op8_langid": langid.query,
        "op9_urls": urls.query,
        "op10_substrings": substrings.query,
        "op11_exact": exact.query,
        "op12_periods": periods.query,
        "op13_trie": trie.query,
    }


def oracle_sql():
    return {"op2_mixing": mixing.SQL, "op11_exact": exact.SQL, "op13_trie": trie.SQL}
