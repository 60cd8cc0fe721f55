"""The queries of this subpackage and their DuckDB twins."""

from . import bitsliced, chat, decontamination, licenses, line_dedup, packing, pii, quality, resampling, sharding, simhash, structure, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_chat_formatting": chat.op2_chat_formatting,
    "op3_sharding": sharding.op3_sharding,
    "op4_best_fit_packing": packing.op4_best_fit_packing,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_pii_surrogates": pii.op6_pii,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_quality_rules": quality.op8_quality_rules,
    "op9_simhash": simhash.op9_simhash,
    "op10_decontamination": decontamination.op10_decontamination,
    "op11_structure_repair": structure.op11_structure_repair,
    "op12_top_k_search": bitsliced.op12_top_k_search,
    "op13_importance_resampling": resampling.op13_importance_resampling,
}

#: The rest of the queries have no short SQL form (hash ring, tokenizer, learnt scores, sketches); tests/llm has brute-force twins.
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op5_license_scan": licenses.sql(),
    "op11_structure_repair": structure.SQL,
    "op12_top_k_search": bitsliced.SQL,
    "op13_importance_resampling": resampling.SQL,
}
