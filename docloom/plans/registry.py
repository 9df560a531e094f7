"""All registered queries of the library and their SQL."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docloom.plans.fx import with_views
from docloom.sources.fixtures import Corpus

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
MODULES = ["q_catalog", "q_meta", "q_search", "q_stats", "q_versions", "q_clauses", "q_structure", "q_extraction", "q_audits", "q_sampling", "q_evaluation", "q_incremental", "q_changes", "q_review", "q_passes", "q_streaming", "q_bundles", "q_sources"]


def query(name: str, sql: str | None = None):
    """Register a function of a Corpus as a query; ``sql`` may name the derived tables."""

    def add(fn: Callable[[Corpus], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Corpus(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = with_views(sql)
        return fn

    return add


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["keyword_search"](spark, sf_dir)


for _name in MODULES:
    if importlib.util.find_spec(f"docloom.plans.{_name}"):
        importlib.import_module(f"docloom.plans.{_name}")
