"""The queries of this subpackage and, where SQL can express them, their SQL."""

from . import byte_bpe, chat_format, exact_dedup, html_extract, language_id, minhash_dedup, packing, search, suffix_dedup, toxicity

QUERIES = {
    "op1_exact_dedup": exact_dedup.op1_exact_dedup,
    "op2_suffix_dedup": suffix_dedup.op2_suffix_dedup,
    "op3_packing": packing.op3_packing,
    "op4_byte_bpe": byte_bpe.op4_byte_bpe,
    "op5_minhash_dedup": minhash_dedup.op5_minhash_dedup,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language_id": language_id.op7_language_id,
    "op8_topk_search": search.op8_topk_search,
    "op9_chat_format": chat_format.op9_chat_format,
    "op10_html_extract": html_extract.op10_html_extract,
}

SQL = {"op1_exact_dedup": exact_dedup.SQL, "op8_topk_search": search.SQL, "op9_chat_format": chat_format.SQL}
