"""The registered queries of this package and their SQL twins where SQL can express them."""

from __future__ import annotations

from territoria.llm import chat, decontam, exact, inner, langid, lines, packing, secrets, sharding, simhash, substrings, trie, variants

QUERIES = {f.__name__: f for f in (
    decontam.op1_decontamination, substrings.op2_substring_dedup, simhash.op3_simhash, packing.op4_packing, secrets.op5_secret_scan,
    langid.op6_language_id, sharding.op7_sharding, lines.op8_line_dedup, chat.op9_chat_formatting, exact.op10_exact_dedup,
    inner.op11_topk_search, trie.op12_prefix_trie, variants.op13_spelling_variants)}

SQL = {"op2_substring_dedup": substrings.SQL, "op8_line_dedup": lines.SQL, "op9_chat_formatting": chat.SQL, "op10_exact_dedup": exact.SQL,
       "op11_topk_search": inner.SQL, "op12_prefix_trie": trie.SQL}
