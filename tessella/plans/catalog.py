"""The named queries over the tables of a data folder, each with the SQL it must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans import graphs, joins, models

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
FLAGSHIP = "j1_descriptor_join"

for _module in (joins, graphs, models):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
