"""The queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

import importlib.util

from snapledger.llm import (
    byte_bpe, decontaminate, exact_dedup, html_main, kd_clusters, language_id, lm_scoring, mixing, quality_knn, simhash, token_output, vector_codes, warc,
)

MODULES = (
    decontaminate, language_id, token_output, simhash, warc, mixing, quality_knn, exact_dedup, html_main, lm_scoring, vector_codes,
    kd_clusters, byte_bpe,
)


def queries() -> dict:
    found = {name: getattr(m, name) for m in MODULES for name in dir(m) if name.startswith("op") and name[2].isdigit()}
    if importlib.util.find_spec("corpus_pipeline") is not None:
        import corpus_pipeline

        found["pipeline"] = corpus_pipeline.run
    return found


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.SQL.items()}
