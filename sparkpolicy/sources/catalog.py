"""The documents under ``data``: tables and small JSON documents."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Catalog:
    """Tables by name, and one JSON document for all the rest.

    A NULL cell of a table is an absent key. ``document`` values are small: they become literals of the plan.
    ``indexes`` names, for tables whose rows have an order, the column that holds a row's index from 0 without gaps.
    """

    tables: dict[str, DataFrame] = field(default_factory=dict)
    base: dict = field(default_factory=dict)
    indexes: dict[str, str] = field(default_factory=dict)

    def table(self, name: str, df: DataFrame, index: str | None = None) -> Catalog:
        return Catalog({**self.tables, name: df}, self.base, {**self.indexes, **({name: index} if index else {})})

    def document(self, name: str, value: object) -> Catalog:
        return Catalog(self.tables, {**self.base, name: value}, self.indexes)

    def document_at(self, path: tuple[str, ...]) -> object | None:
        x: object = self.base
        for p in path:
            if not isinstance(x, dict) or p not in x:
                return None
            x = x[p]
        return x

    @classmethod
    def parquet(cls, spark: SparkSession, folder: str, *names: str) -> Catalog:
        """Tables from the Parquet files ``folder/<name>.parquet``."""
        return cls({n: spark.read.parquet(f"{folder}/{n}.parquet") for n in names})


def json_column(df: DataFrame, column: str, schema: str | None = None) -> DataFrame:
    """A column of JSON text as a document: of a declared schema, or else as a variant. Malformed text is undefined."""
    return df.withColumn(column, F.try_parse_json(column) if schema is None else F.from_json(column, schema))


def load_document(path: str, *, aliases: bool = False) -> object:
    """A JSON or YAML file on the driver; YAML anchors are refused unless ``aliases`` allows them."""
    source = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        return json.loads(source)
    try:
        import yaml
    except ImportError as e:
        raise ValueError("reading YAML needs the yaml package") from e
    if not aliases and any(isinstance(t, (yaml.AliasToken, yaml.AnchorToken)) for t in yaml.scan(source)):
        raise ValueError("YAML aliases are not enabled")
    return yaml.safe_load(source)
