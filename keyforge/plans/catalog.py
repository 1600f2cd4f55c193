"""Entry points for the driver: all registered queries and their oracles."""

from __future__ import annotations

import functools
import importlib

from keyforge.plans import registry
from keyforge.session import tune

MODULES = ("q_text", "q_eval", "q_extract", "q_prompt", "q_model", "q_stages", "q_ingest", "q_sup")


def _load():
    for m in MODULES:
        importlib.import_module(f"keyforge.plans.{m}")


def _wrap(fn):
    @functools.wraps(fn)
    def run(spark, sf_dir):
        tune(spark)
        return fn(spark, sf_dir)
    return run


def queries():
    _load()
    return {k: _wrap(v) for k, v in registry.QUERIES.items()}


def oracle_sql():
    _load()
    return dict(registry.ORACLE)


def flagship(spark, sf_dir):
    _load()
    tune(spark)
    return registry.QUERIES["agg6_method_report"](spark, sf_dir)
