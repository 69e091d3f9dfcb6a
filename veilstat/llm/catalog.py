"""Queries of this package, and their SQL where SQL can express them."""

from __future__ import annotations

from . import hnsw, lines, mixing, neardup, pieces, secrets, substrings, tokens, toxicity, vectors

QUERIES = {
    "op1_line_dedup": lines.op1_line_dedup,
    "op2_pivot_topk": vectors.op2_pivot_topk,
    "op3_minhash_neardup": neardup.op3_minhash_neardup,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_token_ids": tokens.op5_token_ids,
    "op6_secret_scan": secrets.op6_secret_scan,
    "op7_substring_dedup": substrings.op7_substring_dedup,
    "op8_hnsw": hnsw.op8_hnsw,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_sentencepiece": pieces.op10_sentencepiece,
}
ORACLES = {"op2_pivot_topk": vectors.OP2_SQL, "op3_minhash_neardup": neardup.OP3_SQL, "op4_mix_sources": mixing.OP4_SQL, "op7_substring_dedup": substrings.OP7_SQL}
