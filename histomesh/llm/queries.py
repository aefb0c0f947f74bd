"""The package's queries and their SQL, for the entry point."""

from __future__ import annotations

from histomesh.llm import decontaminate, html, langid, mixing, paragraphs, quality, simhash, tokens, url_lm, warc

QUERIES = {
    "op1_url_lm": url_lm.op1_url_lm,
    "op2_paragraphs": paragraphs.op2_paragraphs,
    "op3_warc": warc.op3_warc,
    "op4_quality": quality.op4_quality,
    "op5_langid": langid.op5_langid,
    "op6_simhash": simhash.op6_simhash,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_mixing": mixing.op8_mixing,
    "op9_tokens": tokens.op9_tokens,
    "op10_html": html.op10_html,
}

ORACLE_SQL = {"op3_warc": warc.OP3_SQL, "op4_quality": quality.OP4_SQL, "op7_decontaminate": decontaminate.OP7_SQL}
