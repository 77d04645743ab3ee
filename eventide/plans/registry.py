"""All registered queries and oracles of the library proper."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import inputs  # noqa: F401  defines the named inputs
from .built import QUERIES as BUILT
from .dialect import Statement
from .lists import QUERIES as LISTS
from .negatives import QUERIES as NEGATIVES
from .streams import QUERIES as STREAMS
from .temporal import QUERIES as TEMPORAL
from .windows import QUERIES as WINDOWS

STATEMENTS: dict[str, Statement] = {**BUILT, **TEMPORAL, **WINDOWS, **LISTS, **NEGATIVES, **STREAMS}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: s.query() for name, s in STATEMENTS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: s.duckdb() for name, s in STATEMENTS.items() if s.sql or s.oracle}
