"""The registered queries of the corpus operators and, where SQL can express one, its SQL."""

from __future__ import annotations

from kindred.llm import chat, hostrules, langid, mixing, nearjoin, orderhash, packing, pivots, quality, ring, seenlines, toxicity, whitening

QUERIES = {
    "op1_ring": ring.op1_ring,
    "op2_mixing": mixing.op2_mixing,
    "op3_pivots": pivots.op3_pivots,
    "op4_near_join": nearjoin.op4_near_join,
    "op5_chat": chat.op5_chat,
    "op6_langid": langid.op6_langid,
    "op7_packing": packing.op7_packing,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_order_minhash": orderhash.op9_order_minhash,
    "op10_quality": quality.op10_quality,
    "op11_whitening": whitening.op11_whitening,
    "op12_host_rules": hostrules.op12_host_rules,
    "op13_seen_lines": seenlines.op13_seen_lines,
}

ORACLE_SQL = {
    "op2_mixing": mixing.OP2_SQL,
    "op3_pivots": pivots.OP3_SQL,
    "op4_near_join": nearjoin.OP4_SQL,
    "op5_chat": chat.OP5_SQL,
    "op12_host_rules": hostrules.OP12_SQL,
    "op13_seen_lines": seenlines.OP13_SQL,
}
