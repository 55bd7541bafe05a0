"""Queries of the training-data operators and the SQL that gives the same rows."""

from __future__ import annotations

from atomflow.llm import op1, op2, op3, op4, op5, op6, op7, op8, op9, op10, pipeline


def queries() -> dict:
    return {
        "op1_chat_format": op1.op1_chat_format,
        "op2_bpe": op2.op2_bpe,
        "op3_minhash": op3.op3_minhash,
        "op4_toxicity": op4.op4_toxicity,
        "op5_best_fit_packing": op5.op5_best_fit_packing,
        "op6_near_vectors": op6.op6_near_vectors,
        "op7_substring_dedup": op7.op7_substring_dedup,
        "op8_token_matrices": op8.op8_token_matrices,
        "op9_warc": op9.op9_warc,
        "op10_exact_dedup": op10.op10_exact_dedup,
        "pipeline": pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": op1.SQL, "op3_minhash": op3.SQL, "op6_near_vectors": op6.SQL, "op7_substring_dedup": op7.SQL, "op9_warc": op9.SQL, "op10_exact_dedup": op10.SQL}
