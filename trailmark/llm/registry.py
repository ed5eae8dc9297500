"""The queries of this subpackage. Those without SQL are held against a brute-force version, a round trip or held-out labels in tests/llm."""

from __future__ import annotations

from . import contamination, fingerprints, jaccard, ledger, minhash, mixture, oracles, paragraphs, quality, resampling, substrings, token_files, toxicity, vector_codes


def queries() -> dict:
    return {
        "op1_fingerprints": fingerprints.op1_fingerprints,
        "op2_contamination": contamination.op2_contamination,
        "op3_mixture": mixture.op3_mixture,
        "op4_substrings": substrings.op4_substrings,
        "op5_token_files": token_files.op5_token_files,
        "op6_toxicity": toxicity.op6_toxicity,
        "op7_paragraphs": paragraphs.op7_paragraphs,
        "op8_quality": quality.op8_quality,
        "op9_ledger": ledger.op9_ledger,
        "op10_jaccard": jaccard.op10_jaccard,
        "op11_vector_codes": vector_codes.op11_vector_codes,
        "op12_resampling": resampling.op12_resampling,
        "op13_minhash": minhash.op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
