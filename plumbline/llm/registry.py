"""Queries of the training-data operators and their DuckDB twins."""

from __future__ import annotations

from . import chat, cover_tree, decontaminate, mixing, ngram_join, suffix_dedup, surrogates, token_files, toxicity, warc

QUERIES = {
    "op1_cover_tree": cover_tree.op1_cover_tree,
    "op2_decontaminate": decontaminate.op2_decontaminate,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_surrogates": surrogates.op4_surrogates,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_warc": warc.op6_warc,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_chat_format": chat.op8_chat_format,
    "op9_token_files": token_files.op9_token_files,
    "op10_mixing": mixing.op10_mixing,
}

ORACLES: dict[str, str] = {
    "op1_cover_tree": cover_tree.ORACLE,
    "op2_decontaminate": decontaminate.ORACLE,
    "op6_warc": warc.ORACLE,
    "op8_chat_format": chat.ORACLE,
}
