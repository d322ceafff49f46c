"""The queries of this subpackage and their oracles."""

from __future__ import annotations

from importlib import import_module

MODULES = [
    "tidewright.llm.url_filter",
    "tidewright.llm.html_extract",
    "tidewright.llm.embedding_dedup",
    "tidewright.llm.quality_classifier",
    "tidewright.llm.packing",
    "tidewright.llm.warc",
    "tidewright.llm.quality_rules",
    "tidewright.llm.token_shards",
    "tidewright.llm.mixing",
    "tidewright.llm.minhash_dedup",
    "tidewright.llm.lexical_search",
    "tidewright.llm.importance",
    "tidewright.llm.license_scan",
]


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    out = {k: f for m in MODULES for k, f in import_module(m).QUERIES.items()}
    out["pipeline"] = _pipeline
    return out


def oracle_sql() -> dict:
    return {k: s for m in MODULES for k, s in import_module(m).ORACLES.items()}
