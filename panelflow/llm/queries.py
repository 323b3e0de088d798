"""Registered queries of this subpackage, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from panelflow.llm import (
    alignment,
    chat,
    decontaminate,
    katz,
    lines,
    mixing,
    quality,
    simhash,
    suffix,
    templates,
    urls,
    warc,
    whitening,
)

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_mixing": mixing.op2_mixing,
    "op3_katz": katz.op3_katz,
    "op4_suffix": suffix.op4_suffix,
    "op5_chat": chat.op5_chat,
    "op6_quality": quality.op6_quality,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_warc": warc.op8_warc,
    "op9_lines": lines.op9_lines,
    "op10_urls": urls.op10_urls,
    "op11_whitening": whitening.op11_whitening,
    "op12_templates": templates.op12_templates,
    "op13_alignment": alignment.op13_alignment,
}

ORACLE_SQL = {
    "op2_mixing": mixing.sql(),
    "op5_chat": chat.SQL,
    "op8_warc": warc.SQL,
    "op10_urls": urls.SQL,
}
