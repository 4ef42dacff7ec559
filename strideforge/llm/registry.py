"""The queries of the training-data operators: one opN_<name> each, and the pipeline."""

import importlib

#: Modules of this subpackage that hold a query.
MODULES = [
    "line_dedup",
    "html_text",
    "byte_bpe",
    "secret_crf",
    "minhash",
    "bm25_leaks",
    "warc",
    "quality_ftrl",
    "ivfpq",
    "license_align",
    "periodic_runs",
    "conversation_repair",
    "pii_votes",
]


def _modules():
    return [importlib.import_module(f"strideforge.llm.{m}") for m in MODULES]


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries():
    found = {k: v for m in _modules() for k, v in m.QUERIES.items()}
    found["pipeline"] = _pipeline
    return found


def oracle_sql():
    import corpus_pipeline

    found = {k: v for m in _modules() for k, v in m.ORACLE_SQL.items()}
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
