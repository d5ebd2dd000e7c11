"""The queries of this subpackage and their SQL, by name."""

from rollgrid.llm import clustering, decontaminate, filter_audit, html_text, language_id, line_dedup, mixing, near_dedup, packing, quality, substring_dedup, token_counts, top_k

QUERIES = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_language_id": language_id.op2_language_id,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_quality": quality.op5_quality,
    "op6_top_k": top_k.op6_top_k,
    "op7_mixing": mixing.op7_mixing,
    "op8_html_text": html_text.op8_html_text,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_clusters": clustering.op11_clusters,
    "op12_packing": packing.op12_packing,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}

ORACLE_SQL = {
    "op3_line_dedup": line_dedup.OP3_SQL,
    "op4_near_dedup": near_dedup.OP4_SQL,
    "op6_top_k": top_k.OP6_SQL,
    "op7_mixing": mixing.OP7_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op10_substring_dedup": substring_dedup.OP10_SQL,
    "op11_clusters": clustering.OP11_SQL,
    "op13_filter_audit": filter_audit.OP13_SQL,
}
