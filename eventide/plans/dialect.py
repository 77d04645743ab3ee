"""One statement of a query, read by Spark over DataFrames and by DuckDB over its views.

A statement is SQL over named inputs in braces. Spark gets the inputs as
DataFrames, so Catalyst plans through them; DuckDB gets them as common table
expressions. The few functions the two spell differently are written in capitals
here and spelled out for each.
"""

from __future__ import annotations

import inspect
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# Function spellings, (here, Spark, DuckDB).
SPELLINGS = (
    ("EACH(", "explode(sequence(", "unnest(generate_series("),
    ("PCTL(", "percentile(", "quantile_cont("),
    ("LIST_OF(", "collect_list(", "list("),
    ("SET_SIZE(", "size(", "len("),
    ("SORTED(", "sort_array(", "list_sort("),
    ("UNIX(", "unix_seconds(cast(", "epoch_s(("),
    ("JOINED(", "array_join(", "array_to_string("),
)

#: Inputs: name, (SQL for Spark or a function of other inputs, SQL for DuckDB). Tables of the driver are inputs by their own names.
INPUTS: dict[str, tuple[str | Callable[..., DataFrame], str]] = {}


def define(name: str, spark_sql: str | Callable[..., DataFrame], duck_sql: str | None = None) -> None:
    INPUTS[name] = (spark_sql, duck_sql or spark_sql)


def _spell(sql: str, engine: int) -> str:
    for here, *there in SPELLINGS:
        sql = sql.replace(here, there[engine])
    return sql


def _names(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def frame(spark: SparkSession, sf_dir: str, sql: str, held: dict[str, DataFrame] | None = None) -> DataFrame:
    """The statement as a DataFrame over the tables in a folder."""
    held = {} if held is None else held
    for name in _names(sql):
        if name in held:
            continue
        made = INPUTS[name][0] if name in INPUTS else None
        if callable(made):
            held[name] = made(*[frame(spark, sf_dir, f"SELECT * FROM {{{of}}}", held) for of in inspect.signature(made).parameters])
        else:
            held[name] = frame(spark, sf_dir, made, held) if made else spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(_spell(sql, 0), **{n: held[n] for n in _names(sql)})


def duck(sql: str) -> str:
    """The statement for DuckDB."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _names(text):
            if name in INPUTS and name not in order:
                visit(INPUTS[name][1])
                order.append(name)

    visit(sql)
    plain = lambda text: re.sub(r"\{(\w+)\}", r"\1", _spell(text, 1))
    heads = [f"{n} AS ({plain(INPUTS[n][1])})" for n in order]
    body = plain(sql).strip()
    recursive = bool(re.match(r"WITH\s+RECURSIVE\s", body, re.I))
    if not heads:
        return body
    if m := re.match(r"WITH\s+(RECURSIVE\s+)?", body, re.I):
        return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(heads) + ",\n" + body[m.end() :]
    return "WITH " + ",\n".join(heads) + "\n" + body


@dataclass(frozen=True)
class Statement:
    """A registered query: the survey rows it covers, its SQL, and its oracle where that differs."""

    covers: str
    sql: str
    oracle: str | None = None
    build: Callable[[SparkSession, str], DataFrame] | None = None

    def query(self) -> Callable[[SparkSession, str], DataFrame]:
        return self.build or (lambda spark, sf_dir: frame(spark, sf_dir, self.sql))

    def on(self, spark: SparkSession, **inputs: DataFrame) -> DataFrame:
        """The query over a user's own frames: ``ix`` (src, dst, t, seq), ``q`` (qid, pos, src, t, c), ``sc`` (q and scores s, r, u) and what else it names.

        Inputs that are not given follow from those that are; candidate 0 of a query is the true one, and a query may have any number of candidates.
        """
        if self.build:
            raise ValueError("this query is built by operators; call them on the frame")
        return frame(spark, "", self.sql, dict(inputs))

    def duckdb(self) -> str:
        return duck(self.oracle or self.sql)
