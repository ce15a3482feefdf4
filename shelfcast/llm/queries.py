"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from shelfcast.llm import (
    decontaminate, lexical_search, licences, mixing, neardup_vectors, ngram_join, prefix_trie, quality, sanitise, secrets, sharding, toxicity, warc)

QUERIES = {
    "op1_mix_sources": mixing.op1_mix_sources,
    "op2_sorted_projections": neardup_vectors.op2_sorted_projections,
    "op3_lexicon_automata": toxicity.op3_lexicon_automata,
    "op4_hypergeometric_shards": sharding.op4_hypergeometric_shards,
    "op5_secret_spans": secrets.op5_secret_spans,
    "op6_licences": licences.op6_licences,
    "op7_ngram_jaccard": ngram_join.op7_ngram_jaccard,
    "op8_bayes_support_vectors": quality.op8_bayes_support_vectors,
    "op9_simhash_windows": decontaminate.op9_simhash_windows,
    "op10_warc_normaliser": warc.op10_warc_normaliser,
    "op11_contracted_trie": prefix_trie.op11_contracted_trie,
    "op12_disclosing_terms": sanitise.op12_disclosing_terms,
    "op13_limited_accumulators": lexical_search.op13_limited_accumulators,
}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op2_sorted_projections": neardup_vectors.ORACLE,
    "op5_secret_spans": secrets.ORACLE,
    "op6_licences": licences.ORACLE,
    "op7_ngram_jaccard": ngram_join.ORACLE,
    "op9_simhash_windows": decontaminate.ORACLE,
    "op10_warc_normaliser": warc.ORACLE,
    "op11_contracted_trie": prefix_trie.ORACLE,
    "op12_disclosing_terms": sanitise.ORACLE,
    "op13_limited_accumulators": lexical_search.ORACLE,
}
