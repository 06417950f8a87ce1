"""The registered queries of this subpackage."""

from __future__ import annotations

from . import bpe, exact_dedup, fingerprints, merkle, mixing, near_dedup, packing, pii, quality, suffix_dedup, token_files, toxicity, vector_codes

QUERIES = {
    "op1_token_files": token_files.op1_token_files,
    "op2_simhash": near_dedup.op2_simhash,
    "op3_bpe": bpe.op3_bpe,
    "op4_packing": packing.op4_packing,
    "op5_toxicity": toxicity.op5_toxicity,
    "op7_fingerprints": fingerprints.op7_fingerprints,
    "op8_pii": pii.op8_pii,
    "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
    "op10_quality": quality.op10_quality,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_merkle": merkle.op12_merkle,
    "op13_mixing": mixing.op13_mixing,
}

ORACLE_SQL = {"op6_exact_dedup": exact_dedup.OP6_SQL, "op11_vector_codes": vector_codes.OP11_SQL, "op12_merkle": merkle.OP12_SQL}
