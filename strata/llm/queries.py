"""The registered queries of this subpackage and the SQL that DuckDB can compare them with."""

from __future__ import annotations

from . import best_fit, decontaminate, fertility, hard_negatives, html_text, jaccard_join, line_dedup, lm_scoring, packing, ranked_search, tool_calls, url_filters, warc

MODULES = [warc, decontaminate, html_text, url_filters, packing, line_dedup, lm_scoring, tool_calls, fertility, jaccard_join, hard_negatives, ranked_search, best_fit]
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
QUERIES["pipeline"] = lambda spark, sf_dir: _pipeline(spark, sf_dir)
ORACLE = {name: sql for m in MODULES for name, sql in m.ORACLE.items()}


def _pipeline(spark, sf_dir: str):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
