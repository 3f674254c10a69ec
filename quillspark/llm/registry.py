"""Queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import op1_secrets, op2_language, op3_decontaminate, op4_katz, op5_tokens, op6_quality, op7_pii, op8_substrings, op9_jaccard, op10_bpe, op11_search, op12_urls, op13_centroids, oracles

QUERIES = {
    "op1_secrets": op1_secrets.op1_secrets,
    "op2_language": op2_language.op2_language,
    "op3_decontaminate": op3_decontaminate.op3_decontaminate,
    "op4_katz": op4_katz.op4_katz,
    "op5_tokens": op5_tokens.op5_tokens,
    "op6_quality": op6_quality.op6_quality,
    "op7_pii": op7_pii.op7_pii,
    "op8_substrings": op8_substrings.op8_substrings,
    "op9_jaccard": op9_jaccard.op9_jaccard,
    "op10_bpe": op10_bpe.op10_bpe,
    "op11_search": op11_search.op11_search,
    "op12_urls": op12_urls.op12_urls,
    "op13_centroids": op13_centroids.op13_centroids,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op3_decontaminate": oracles.OP3, "op8_substrings": oracles.OP8, "op9_jaccard": oracles.OP9, "op11_search": oracles.OP11, "op12_urls": oracles.OP12, "op13_centroids": oracles.OP13}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
