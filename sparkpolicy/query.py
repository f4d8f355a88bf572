"""A catalogued policy with SQL for the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from .api import Catalog, Functions, Policy
from .sources.catalog import json_column


@dataclass(frozen=True)
class Query:
    """A policy (without its package line), the rule to read, and SQL for the same rows.

    ``batch`` names the input table and its key; without it the rule is a relation over the tables under ``data``. ``json`` is
    the type of the column ``props``, empty for a variant. ``prepare`` makes the input rows of the table. ``indexes`` names the
    columns with the places of a table's rows, ``functions`` are registered ones, and ``made`` replaces all of that.
    """

    policy: str
    rule: str
    sql: str
    batch: tuple[str, str] | None = None
    json: str | None = None
    prepare: Callable[[DataFrame], DataFrame] | None = None
    indexes: dict[str, str] = field(default_factory=dict)
    functions: Functions | None = None
    made: Callable[[SparkSession, str], DataFrame] | None = None

    def run(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if self.made is not None:
            return self.made(spark, sf_dir)
        policy = Policy(f"package q\n{self.policy}", functions=self.functions.entries if self.functions else None)
        names = sorted({w.split(".")[1] for w in _words(self.policy) if w.startswith("data.") and w.split(".")[1] not in ("cfg", "q")})
        catalog = Catalog.parquet(spark, sf_dir, *names).document("cfg", {"limit": 0})
        for name, column in self.indexes.items():
            catalog = catalog.table(name, catalog.tables[name], index=column)
        if self.batch:
            table, key = self.batch
            df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
            df = json_column(df, "props", self.json or None) if self.json is not None else df
            return policy.decide(df if self.prepare is None else self.prepare(df), self.rule, keys=[key], catalog=catalog)
        return policy.relation(spark, self.rule, catalog)


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z_]+(?:\.[a-z_]+)*", text)
