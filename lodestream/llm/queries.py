"""The queries of the training-data operators, and SQL for those that SQL can express."""

from . import chat, decontaminate, jaccard_join, language_id, line_dedup, packing, pfor, quality_classifier, quality_rules, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_quality_rules": quality_rules.op4_quality_rules,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_language_id": language_id.op6_language_id,
    "op7_ngram_jaccard": jaccard_join.op7_ngram_jaccard,
    "op8_token_ids": pfor.op8_token_ids,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_chat_format": chat.op10_chat_format,
}

SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op7_ngram_jaccard": jaccard_join.OP7_SQL,
    "op10_chat_format": chat.OP10_SQL,
}
