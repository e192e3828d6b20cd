"""One query for each corpus operator, and SQL where it can express the operator."""

from __future__ import annotations

from . import bpe, fingerprints, line_dedup, minhash, mixing, quality, sharding, substring_dedup, token_counts, toxicity

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_bpe": bpe.op3_bpe,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_quality": quality.op6_rows,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_sharding": sharding.op9_sharding,
    "op10_minhash": minhash.op10_minhash,
}
SQL = {
    "op1_mixing": mixing.OP1_SQL,
    "op2_substring_dedup": substring_dedup.OP2_SQL,
    "op4_line_dedup": line_dedup.OP4_SQL,
    "op6_quality": quality.OP6_SQL,
    "op10_minhash": minhash.OP10_SQL,
}
