"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from wavecohort.llm import ann, collocations, decontaminate, langid, licenses, line_dedup, mixing, neardup, pages, quality, search, tokens, topk

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_mixing": mixing.op2_mixing,
    "op3_quality": quality.op3_quality,
    "op4_near_dedup": neardup.op4_near_dedup,
    "op5_token_output": tokens.op5_token_output,
    "op6_html_text": pages.op6_html_text,
    "op7_decontamination": decontaminate.op7_decontamination,
    "op8_licenses": licenses.op8_licenses,
    "op9_language_id": langid.op9_language_id,
    "op10_topk": topk.op10_topk,
    "op11_search": search.op11_search,
    "op12_collocations": collocations.op12_collocations,
    "op13_ann": ann.op13_ann,
}

ORACLE_SQL = {
    "op2_mixing": mixing.SQL,
    "op4_near_dedup": neardup.SQL,
    "op7_decontamination": decontaminate.SQL,
    "op8_licenses": licenses.SQL,
    "op10_topk": topk.SQL,
    "op11_search": search.SQL,
    "op12_collocations": collocations.SQL,
}
