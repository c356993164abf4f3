"""All queries of the file-processing operators, by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewright.operators import files, graph, pictures, rules, tabular
from tidewright.plans import rule_oracles, savings
from tidewright.plans.dialect import oracle, spark_query
from tidewright.streaming import progress

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
for module in (savings, graph, progress, files, pictures):
    QUERIES.update(module.QUERIES)
    ORACLE_SQL.update(module.ORACLE_SQL)
for name, sql in tabular.QUERIES.items():
    QUERIES[name] = spark_query(sql)
    ORACLE_SQL[name] = oracle(sql)
QUERIES.update(rules.QUERIES)
ORACLE_SQL.update(rule_oracles.ORACLE_SQL)
