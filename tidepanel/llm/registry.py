"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from tidepanel.llm import chat_format, collocations, importance, language_id, licenses, mixing, near_dedup, pieces, pii, secrets, token_shards, topk_search, winnowing

QUERIES = {
    "op1_hyperminhash": near_dedup.op1_hyperminhash,
    "op2_pieces": pieces.op2_pieces,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_language_id": language_id.op4_language_id,
    "op5_kd_topk": topk_search.op5_kd_topk,
    "op6_mixing": mixing.op6_mixing,
    "llm_mixing_bounds": mixing.mixing_bounds,
    "op7_winnowing": winnowing.op7_winnowing,
    "op8_pii": pii.op8_pii,
    "op9_licenses": licenses.op9_licenses,
    "op10_secrets": secrets.op10_secrets,
    "op11_importance": importance.op11_importance,
    "op12_token_shards": token_shards.op12_token_shards,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES = {
    "op1_hyperminhash": near_dedup.ORACLE,
    "op3_chat_format": chat_format.ORACLE,
    "op5_kd_topk": topk_search.ORACLE,
    "llm_mixing_bounds": mixing.BOUNDS_SQL,
    "op8_pii": pii.ORACLE,
    "op9_licenses": licenses.ORACLE,
    "op10_secrets": secrets.ORACLE,
    "op11_importance": importance.ORACLE,
    "op13_collocations": collocations.ORACLE,
}
