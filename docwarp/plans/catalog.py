"""All queries of the engine's own operators."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession

from docwarp import plans
from docwarp.plans.registry import ORACLES, QUERIES, Query

for _m in sorted(m.name for m in pkgutil.iter_modules(plans.__path__)):
    if _m not in ("registry", "catalog"):
        importlib.import_module(f"docwarp.plans.{_m}")


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["R18_batched_search"](spark, sf_dir)


def queries() -> dict[str, Query]:
    return QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES
