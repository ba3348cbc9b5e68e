"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from fretelens.llm.ann_hilbert import op1_hilbert_ann
from fretelens.llm.filter_audit import OP12_SQL, op12_filter_audit
from fretelens.llm.fingerprints import op11_fingerprints
from fretelens.llm.html_region import op4_html_region
from fretelens.llm.jaccard_join import op2_jaccard_join
from fretelens.llm.lang_kernel import op6_language_kernel
from fretelens.llm.line_dedup import op5_line_minhash
from fretelens.llm.lm_automaton import op7_backoff_automaton
from fretelens.llm.mix_sources import op3_mix_sources
from fretelens.llm.pack_best_fit import op8_best_fit_packing
from fretelens.llm.suffix_dedup import op9_suffix_dedup
from fretelens.llm.target_sampling import op13_target_sampling
from fretelens.llm.topk_norms import OP10_SQL, op10_norm_topk

QUERIES = {
    "op1_hilbert_ann": op1_hilbert_ann,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_mix_sources": op3_mix_sources,
    "op4_html_region": op4_html_region,
    "op5_line_minhash": op5_line_minhash,
    "op6_language_kernel": op6_language_kernel,
    "op7_backoff_automaton": op7_backoff_automaton,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_norm_topk": op10_norm_topk,
    "op11_fingerprints": op11_fingerprints,
    "op12_filter_audit": op12_filter_audit,
    "op13_target_sampling": op13_target_sampling,
}
ORACLE = {
    "op10_norm_topk": OP10_SQL,
    "op12_filter_audit": OP12_SQL,
}
