"""The registered queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from driftcurve.llm import embedding_dedup, exact_dedup, html_extract, line_dedup, mixing, pieces, pii, quality, repair, simhash, topk_search, variants, warc


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_warc_derivatives": warc.op2_warc_derivatives,
        "op3_temperature_mix": mixing.op3_temperature_mix,
        "op4_html_extract": html_extract.op4_html_extract,
        "op5_quality": quality.op5_quality,
        "op6_pii": pii.op6_pii,
        "op7_sentencepiece": pieces.op7_sentencepiece,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_embedding_near_dedup": embedding_dedup.op9_embedding_near_dedup,
        "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
        "op11_conversation_repair": repair.op11_conversation_repair,
        "op12_exact_top_k": topk_search.op12_exact_top_k,
        "op13_spelling_variants": variants.op13_spelling_variants,
    }


def oracle_sql() -> dict:
    return {
        "op1_line_dedup": line_dedup.OP1_SQL,
        "op8_exact_dedup": exact_dedup.OP8_SQL,
        "op9_embedding_near_dedup": embedding_dedup.OP9_SQL,
        "op11_conversation_repair": repair.OP11_SQL,
        "op12_exact_top_k": topk_search.OP12_SQL,
        "op13_spelling_variants": variants.OP13_SQL,
    }
