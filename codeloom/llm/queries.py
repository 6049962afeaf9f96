"""The operators' queries and their SQL, by name."""

from codeloom.llm import bpe, chat, html_text, jaccard, mixing, neardup, pitman_yor, token_files, topk, toxicity

QUERIES = {
    "op8_lm_scores": pitman_yor.op8_lm_scores,
    "op1_topk": topk.op1_topk,
    "op6_embedding_neardup": neardup.op6_embedding_neardup,
    "op7_html_text": html_text.op7_html_text,
    "op10_ngram_jaccard": jaccard.op10_ngram_jaccard,
    "op2_chat_format": chat.op2_chat_format,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_token_files": token_files.op5_token_files,
    "op9_mixing": mixing.op9_mixing,
    "op3_byte_bpe": bpe.op3_byte_bpe,
}

ORACLES: dict[str, str] = {"op2_chat_format": chat.ORACLE, "op1_topk": topk.ORACLE}
