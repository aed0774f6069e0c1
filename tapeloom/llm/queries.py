"""The queries of this package, and the SQL of those that SQL can express."""

from functools import wraps
from importlib import import_module

from .common import small_batches

MODULES = ("mixing", "url_filters", "toxicity", "language_id", "quality_rules", "bpe", "ngram_jaccard", "vector_topk", "pii", "chat_format", "importance", "vector_codes", "quality_model")


def _with_small_batches(query):
    @wraps(query)
    def run(spark, sf_dir):
        small_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    return {name: _with_small_batches(f) for m in MODULES for name, f in import_module(f".{m}", __package__).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in import_module(f".{m}", __package__).ORACLE.items()}
