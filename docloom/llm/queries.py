"""The subpackage's registered queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import alignment, decontaminate, hmm, lines, mixing, packing, parsing, quality, sharding, simhash, trie, urlfilter, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_prefix_free_parsing": parsing.op2_prefix_free_parsing,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_warc": warc.op4_warc,
    "op5_hmm": hmm.op5_hmm,
    "op6_url_filter": urlfilter.op6_url_filter,
    "op7_simhash": simhash.op7_simhash,
    "op8_poisson_mix": mixing.op8_poisson_mix,
    "op9_fuzzy_lines": lines.op9_fuzzy_lines,
    "op10_suffix_repetition": quality.op10_suffix_repetition,
    "op11_best_fit_packing": packing.op11_best_fit_packing,
    "op12_cross_tokenizer_alignment": alignment.op12_cross_tokenizer_alignment,
    "op13_conversation_trie": trie.op13_conversation_trie,
}

ORACLE_SQL = {
    "op2_prefix_free_parsing": parsing.OP2_SQL,
    "op3_decontaminate": decontaminate.OP3_SQL,
    "op4_warc": warc.OP4_SQL,
    "op8_poisson_mix": mixing.OP8_SQL,
    "op10_suffix_repetition": quality.OP10_SQL,
    "op13_conversation_trie": trie.OP13_SQL,
}
