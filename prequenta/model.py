"""The model row: what is fitted, stored and turned into scoring expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Row
from pyspark.sql import types as T

from prequenta.functions.cells import double_sql

# The record width the application is set up for, and the names and
# output labels of its two models.
N_FEATURES = 30
PRETRAINED = "pretrained"
COLD = "cold"
SERIES_LABEL = {PRETRAINED: "ACC pretrained", COLD: "ACC"}
KEY_SUFFIX = {PRETRAINED: ":pre", COLD: ""}

MODEL_SCHEMA = T.StructType(
    [
        T.StructField("model", T.StringType(), False),
        T.StructField("version", T.LongType(), False),
        T.StructField("weights", T.ArrayType(T.DoubleType(), False), False),
        T.StructField("intercept", T.DoubleType(), False),
        T.StructField("n_features", T.IntegerType(), False),
        T.StructField("n_classes", T.IntegerType(), False),
    ]
)


@dataclass(frozen=True)
class Model:
    """A binary linear classifier. Its size is fixed by the record width, not by the data."""

    name: str
    weights: tuple[float, ...]
    intercept: float = 0.0
    version: int = 0
    n_classes: int = 2

    def __post_init__(self) -> None:
        if not self.name.isidentifier():
            raise ValueError(f"a model name is part of column names, so it cannot be {self.name!r}")

    @property
    def n_features(self) -> int:
        return len(self.weights)

    def at_version(self, version: int) -> "Model":
        return replace(self, version=version)

    def as_sql(self) -> str:
        """The model as one row of a VALUES table with the columns of ``MODEL_SCHEMA``."""
        weights = ", ".join(double_sql(w) for w in self.weights)
        intercept = double_sql(self.intercept)
        return f"('{self.name}', {self.version}L, array({weights}), {intercept}, {self.n_features}, {self.n_classes})"

    @classmethod
    def from_row(cls, row: Row) -> "Model":
        return cls(
            row["model"], tuple(row["weights"]), row["intercept"], row["version"], row["n_classes"]
        )

    @classmethod
    def of(cls, name: str, weights: Sequence[float], intercept: float = 0.0) -> "Model":
        return cls(name, tuple(float(w) for w in weights), float(intercept))


def cold_model(name: str = COLD, n_features: int = N_FEATURES) -> Model:
    """A model that has seen nothing: zero weights, so it predicts 0 for every row."""
    return Model.of(name, [0.0] * n_features)
