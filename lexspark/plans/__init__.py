"""Driver queries (Spark) with their DuckDB oracle SQL, registered by name."""

from importlib import import_module

from .registry import ORACLES, QUERIES

_MODULES = ["text_q", "filter_q", "instruct_q", "split_q", "eval_q", "ops_q", "vocab_q", "sketch_q"]


def load_all():
    for m in _MODULES:
        import_module(f"{__name__}.{m}")
    return QUERIES, ORACLES
