"""The queries of this subpackage by name, and the SQL that checks them where SQL can."""

from __future__ import annotations

from tidemill.llm import op1_minhash, op2_langid, op3_urls, op4_collide, op5_pack, op6_search, op7_mix, op8_toxicity, op9_quality, op10_chat, op11_quality_rules, op12_prefix_trie, op13_spelling

QUERIES = {
    "op1_minhash": op1_minhash.op1_minhash,
    "op2_langid": op2_langid.op2_langid,
    "op3_urls": op3_urls.op3_urls,
    "op4_collide": op4_collide.op4_collide,
    "op5_pack": op5_pack.op5_pack,
    "op6_search": op6_search.op6_search,
    "op7_mix": op7_mix.op7_mix,
    "op8_toxicity": op8_toxicity.op8_toxicity,
    "op9_quality": op9_quality.op9_quality,
    "op10_chat": op10_chat.op10_chat,
    "op11_quality_rules": op11_quality_rules.op11_quality_rules,
    "op12_prefix_trie": op12_prefix_trie.op12_prefix_trie,
    "op13_spelling": op13_spelling.op13_spelling,
}
ORACLES = {
    "op1_minhash": op1_minhash.ORACLE_SQL,
    "op3_urls": op3_urls.ORACLE_SQL,
    "op4_collide": op4_collide.ORACLE_SQL,
    "op7_mix": op7_mix.ORACLE_SQL,
    "op10_chat": op10_chat.ORACLE_SQL,
    "op12_prefix_trie": op12_prefix_trie.ORACLE_SQL,
    "op13_spelling": op13_spelling.ORACLE_SQL,
}
