"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from massflow.llm import bpe, chat, decontaminate, exact_dedup, extract, langid, lm, minhash, quality, repair, secrets, trie, warc

QUERIES = {
    "op1_warc": warc.op1,
    "op2_byte_bpe": bpe.op2,
    "op3_language_id": langid.op3,
    "op4_decontamination": decontaminate.op4,
    "op5_minhash_dedup": minhash.op5,
    "op6_html_extraction": extract.op6,
    "op7_exact_dedup": exact_dedup.op7,
    "op8_lm_score": lm.op8,
    "op9_quality": quality.op9,
    "op10_secret_scan": secrets.op10,
    "op11_chat_format": chat.op11,
    "op12_prefix_trie": trie.op12,
    "op13_structure_repair": repair.op13,
}

ORACLES = {
    "op5_minhash_dedup": minhash.ORACLE_SQL,
    "op1_warc": warc.ORACLE_SQL,
    "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    "op10_secret_scan": secrets.ORACLE_SQL,
    "op11_chat_format": chat.ORACLE_SQL,
    "op12_prefix_trie": trie.ORACLE_SQL,
    "op13_structure_repair": repair.ORACLE_SQL,
}
