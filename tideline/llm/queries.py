"""Queries of this package and their oracle SQL."""

from __future__ import annotations

from tideline.llm import alignment, chat, langmix, licenses, linededup, mixing, neardup, packing, quality, rules, search, spelling, toxicity

QUERIES = {
    "op1_chat_windows": chat.op1,
    "op2_template_lines": linededup.op2,
    "op3_simhash": neardup.op3,
    "op4_subword_quality": quality.op4,
    "op5_recurrent_toxicity": toxicity.op5,
    "op6_best_fit_packing": packing.op6,
    "op7_tokeniser_fertility": rules.op7,
    "op8_source_mixing": mixing.op8,
    "op9_exact_top_k": search.op9,
    "op10_licence_digests": licenses.op10,
    "op11_trie_frontier": spelling.op11,
    "op12_language_mixture": langmix.op12,
    "op13_token_alignment": alignment.op13,
}
#: Where SQL cannot express a query (digests of formatted text, fingerprints, tokenisers, trained models), tests compare it with brute force.
ORACLE: dict[str, str] = {
    "op2_template_lines": linededup.OP2_SQL,
    "op8_source_mixing": mixing.OP8_SQL,
    "op9_exact_top_k": search.OP9_SQL,
    "op10_licence_digests": licenses.OP10_SQL,
}
