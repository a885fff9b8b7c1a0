"""All queries of the library by name, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code, content, deliveries, filters, graph, issues, knowledge, reports, retrieval, rules, signals, streams, system, text, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
for _module in (usage, text, reports, issues, graph, retrieval, rules, signals, streams, system, filters, knowledge, deliveries, code, content):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
