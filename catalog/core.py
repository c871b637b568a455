"""Query records, output columns shared by both sides, and CTE assembly."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.tables import CTES, Tables

# Suffix -> (Spark expression, SQL expression). Doubles are compared to six
# places, ties to even on both sides; adding 0.0 turns a negative zero into zero.
_CASTS = {
    "d": (
        "rint(cast({0} as double) * 1e6D) / 1e6D + 0.0D",
        "round_even(CAST({0} AS DOUBLE) * 1e6, 0) / 1e6 + 0.0",
    ),
    "l": ("cast({0} as bigint)", "CAST({0} AS BIGINT)"),
    "i": ("cast({0} as int)", "CAST({0} AS INTEGER)"),
    "s": ("cast({0} as string)", "CAST({0} AS VARCHAR)"),
    "b": ("cast({0} as boolean)", "CAST({0} AS BOOLEAN)"),
    "t": ("cast({0} as date)", "CAST({0} AS DATE)"),
    "": ("{0}", "{0}"),
}


@dataclass(frozen=True)
class Query:
    """`columns` lists the output as `name:type` for Spark and SQL alike."""

    name: str
    columns: str
    spark: Callable[[Tables], DataFrame]
    sql: str | None = None

    def _outputs(self) -> list[tuple[str, str]]:
        return [tuple((c + ":").split(":")[:2]) for c in self.columns.split()]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.spark(Tables(spark, sf_dir))
        exprs = [
            F.expr(_CASTS[kind][0].format(f"`{name}`")).alias(name)
            for name, kind in self._outputs()
        ]
        return df.select(*exprs)

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        exprs = ", ".join(
            f"{_CASTS[kind][1].format(chr(34) + name + chr(34))} AS \"{name}\""
            for name, kind in self._outputs()
        )
        return assemble(f"SELECT {exprs} FROM ({self.sql}) AS result")


def assemble(sql: str) -> str:
    """Prefix the CTEs that the text names, directly or through others."""
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\b\w+\b", text)):
            if name in CTES and name not in ordered:
                visit(CTES[name])
                ordered.append(name)

    visit(sql)
    if not ordered:
        return sql
    parts = ",\n".join(f"{n} AS ({CTES[n].strip()})" for n in ordered)
    return f"WITH {parts}\n{sql}"
