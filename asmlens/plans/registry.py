"""The table of registered queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asmlens.plans.adapters import Tables

SCALE = 1e6


@dataclass(frozen=True)
class Entry:
    build: Callable[[Tables], DataFrame]
    sql: str | None
    rounded: tuple[str, ...]

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        df = self.build(Tables(spark, sf_dir))
        return df.withColumns({c: F.rint(F.col(c).cast("double") * SCALE) / SCALE + F.lit(0.0) for c in self.rounded})

    def oracle(self) -> str | None:
        if not self.sql or not self.rounded:
            return self.sql
        replace = ", ".join(f"round_even({c}::DOUBLE * {SCALE}::DOUBLE, 0) / {SCALE}::DOUBLE + 0.0::DOUBLE AS {c}" for c in self.rounded)
        return f"SELECT * REPLACE ({replace}) FROM ({self.sql})"


ENTRIES: dict[str, Entry] = {}


def query(name: str, sql: str | None = None, rounded: str = ""):
    """Register a builder; ``rounded`` names floating columns, which both engines round."""

    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(build, sql, tuple(rounded.split()))
        return build

    return add
