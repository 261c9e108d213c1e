"""Registry of the subpackage's queries: name -> (function, DuckDB SQL or None)."""

from __future__ import annotations

from . import (
    bestfit_packing, exact_topk, language_id, lm_scoring, mix_sources, ngram_join, periodic_runs, prefix_trie, quality_rules, suffix_dedup, toxicity,
    warc, wrappers,
)

QUERIES = {
    "op1_exact_topk": (exact_topk.op1_exact_topk, exact_topk.SQL),
    "op2_language_id": (language_id.op2_language_id, None),
    "op3_lm_scoring": (lm_scoring.op3_lm_scoring, lm_scoring.SQL),
    "op4_suffix_dedup": (suffix_dedup.op4_suffix_dedup, None),
    "op5_mix_sources": (mix_sources.op5_mix_sources, mix_sources.SQL),
    "op6_toxicity": (toxicity.op6_toxicity, None),
    "op7_bestfit_packing": (bestfit_packing.op7_bestfit_packing, None),
    "op8_warc": (warc.op8_warc, warc.SQL),
    "op9_ngram_jaccard_join": (ngram_join.op9_ngram_jaccard_join, ngram_join.SQL),
    "op10_quality_rules": (quality_rules.op10_quality_rules, None),
    "op11_wrappers": (wrappers.op11_wrappers, wrappers.SQL),
    "op12_periodic_runs": (periodic_runs.op12_periodic_runs, None),
    "op13_prefix_trie": (prefix_trie.op13_prefix_trie, prefix_trie.SQL),
}
