"""Registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from rollscale.llm import (
    bytepair,
    classifier,
    exact,
    htmltext,
    lines,
    neardup,
    neighbours,
    packing,
    personal,
    prefixes,
    rules,
    substrings,
    whitening,
)

MODULES = {
    "op1_power_of_two_packing": packing,
    "op2_weak_supervision_pii": personal,
    "op3_chosen_path_near_dup": neardup,
    "op4_byte_bpe": bytepair,
    "op5_line_dedup": lines,
    "op6_recurrent_html_blocks": htmltext,
    "op7_weak_supervision_rules": rules,
    "op8_ftrl_quality": classifier,
    "op9_block_anchor_repeats": substrings,
    "op10_exact_dedup": exact,
    "op11_conversation_prefix_trie": prefixes,
    "op12_multiprobe_neighbours": neighbours,
    "op13_bit_sliced_whitening": whitening,
}


def queries() -> dict:
    return {name: module.query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: module.SQL for name, module in MODULES.items() if module.SQL}
