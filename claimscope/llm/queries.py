"""Registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from claimscope.llm import audit, bpe, chat, decontaminate, exact, fingerprints, line_dedup, near, secrets, toxicity, trie, url_filter, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_bpe": bpe.op2_bpe,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_near": near.op4_near,
    "op5_url_filter": url_filter.op5_url_filter,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_chat": chat.op8_chat,
    "op9_fingerprints": fingerprints.op9_fingerprints,
    "op10_secrets": secrets.op10_secrets,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_exact_dedup": exact.op12_exact_dedup,
    "op13_prefix_trie": trie.op13_prefix_trie,
}

SQL: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op5_url_filter": url_filter.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op8_chat": chat.SQL,
    "op11_filter_audit": audit.SQL,
    "op12_exact_dedup": exact.SQL,
    "op13_prefix_trie": trie.SQL,
}
