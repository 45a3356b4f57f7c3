"""Registered queries: a Spark callable, an output spec and, where SQL can say it, an oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import ship_package

DIGITS = {"f": 6, "g": 3}

# Short decimals often end in a 5 just past the last digit, where engines round
# apart; a nudge far below the precision kept settles those.
NUDGE = 3.7e-10


@dataclass(frozen=True)
class Query:
    build: Callable[[SparkSession, str], DataFrame]
    spec: tuple[tuple[str, str], ...]
    oracle: str | None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        # Times without a zone are read as UTC everywhere in the library.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship_package(spark)
        return tidy(self.build(spark, sf_dir), self.spec)

    def sql(self) -> str | None:
        return None if self.oracle is None else tidy_sql(self.oracle, self.spec)


QUERIES: dict[str, Query] = {}


def query(name: str, spec: str, oracle: str | None = None):
    """Register a query. ``spec`` lists output columns as ``name:type``.

    Types: i long, f double rounded to six digits, g to three (large sums), s
    string, b boolean.
    """
    parsed = tuple(tuple(part.split(":")) for part in spec.split())

    def keep(build):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = Query(build, parsed, oracle)
        return build

    return keep


def tidy(df: DataFrame, spec) -> DataFrame:
    cols = []
    for name, kind in spec:
        c = F.col(name)
        if kind == "i":
            c = c.cast("long")
        elif kind in DIGITS:
            # Adding zero turns -0.0 into 0.0.
            c = F.round(c.cast("double") + F.lit(NUDGE), DIGITS[kind]) + F.lit(0.0)
        elif kind == "b":
            c = c.cast("boolean")
        else:
            c = c.cast("string")
        cols.append(c.alias(name))
    return df.select(*cols)


def tidy_sql(sql: str, spec) -> str:
    forms = {
        "i": "cast({c} as bigint)",
        **{k: f"round(cast({{c}} as double) + {NUDGE!r}, {d}) + 0e0" for k, d in DIGITS.items()},
        "b": "cast({c} as boolean)",
        "s": "cast({c} as varchar)",
    }
    cols = ", ".join(f"{forms[kind].format(c=name)} as {name}" for name, kind in spec)
    return f"select {cols} from ({sql}) as result"
