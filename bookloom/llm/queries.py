"""One query per operator over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from bookloom.llm import conversation_trie, decontamination, html_text, matroska, mixing, near_dedup, periodic_runs, quality, quality_rules, token_counts, token_output, toxicity, warc

QUERIES = {
    f.__name__: f
    for f in (
        mixing.op1_mixing, token_counts.op2_token_counts, token_output.op3_token_output, warc.op4_warc, html_text.op5_html_extraction, quality.op6_quality, near_dedup.op7_near_dedup, toxicity.op8_toxicity,
        decontamination.op9_decontamination, matroska.op10_media_columns, quality_rules.op11_quality_rules, periodic_runs.op12_periodic_runs, conversation_trie.op13_conversation_trie,
    )
}
ORACLE: dict[str, str] = {"op1_mixing": mixing.OP1_SQL, "op4_warc": warc.OP4_SQL, "op9_decontamination": decontamination.OP9_SQL, "op13_conversation_trie": conversation_trie.OP13_SQL}
