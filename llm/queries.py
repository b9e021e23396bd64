"""Registered queries of the package and the SQL of those that SQL can express."""

from __future__ import annotations

from importlib import import_module

from llm import common, oracles

#: Query name -> its module; the function bears the query's name.
_MODULES = {
    "op1_external_index_merge": "warc",
    "op2_token_files": "token_files",
    "op3_ownership_frequency": "secrets",
    "op4_set_relation_join": "jaccard",
    "op5_metric_range_join": "vectors",
    "op6_min_cost_flow": "resharding",
    "op7_minimum_bin_slack": "packing",
    "op8_overlapping_chunks": "byte_bpe",
    "op9_closed_syncmers": "syncmers",
    "op10_language_ppm": "language",
    "op11_spelling_kd": "spelling",
    "op12_grammar_repair": "conversations",
    "op13_kneser_ney": "kneser_ney",
}


def _ready(query):
    def run(spark, sf_dir):
        return query(common.tuned(spark), sf_dir)

    return run


QUERIES = {name: _ready(getattr(import_module(f"llm.{module}"), name)) for name, module in _MODULES.items()}
ORACLE: dict[str, str] = oracles.ORACLE
