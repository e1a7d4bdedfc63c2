"""A mined library as four tables plus scalar metadata."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from stridemill import schemas
from stridemill.scale import checkpoint


@dataclass
class Model:
    """A mined library as tables. ``meta`` holds scalars only."""

    skills: DataFrame
    members: DataFrame
    nodes: DataFrame
    edges: DataFrame
    method: str = "tower"
    description: str = ""
    meta: dict[str, Any] = field(default_factory=dict)

    def stored(self) -> Model:
        """The same model with every table cut loose from its plan."""
        tables = {n: checkpoint(getattr(self, n)) for n in ("skills", "members", "nodes", "edges")}
        return replace(self, **tables)


def empty_model(spark: SparkSession, method: str, description: str, meta: dict[str, Any] | None = None) -> Model:
    make = spark.createDataFrame
    return Model(
        make([], schemas.SKILLS), make([], schemas.MEMBERS), make([], schemas.NODES), make([], schemas.EDGES),
        method, description, meta or {},
    )


def columns_of(ddl: str) -> list[str]:
    return StructType.fromDDL(ddl).names
