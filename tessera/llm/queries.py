"""The registered queries of the corpus operators, over whole tables."""

from . import byte_bpe, chat, exact_dedup, filter_audit, hard_negatives, line_dedup, media, ngram_join, packing, quality, simhash, token_files, toxicity

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_exact_dedup": exact_dedup.query,
    "op3_chat": chat.query,
    "op4_ngram_join": ngram_join.query,
    "op5_token_files": token_files.query,
    "op6_byte_bpe": byte_bpe.query,
    "op7_quality": quality.query,
    "op8_packing": packing.query,
    "op9_media": media.query,
    "op10_line_dedup": line_dedup.query,
    "op11_simhash": simhash.query,
    "op12_hard_negatives": hard_negatives.query,
    "op13_filter_audit": filter_audit.query,
}
ORACLE = {
    "op2_exact_dedup": exact_dedup.ORACLE,
    "op3_chat": chat.ORACLE,
    "op4_ngram_join": ngram_join.ORACLE,
    "op10_line_dedup": line_dedup.ORACLE,
    "op12_hard_negatives": hard_negatives.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
