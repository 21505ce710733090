"""Side-by-side prediction with any number of models."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from prequenta.functions import cells as C
from prequenta.model import Model


def prediction_column(name: str) -> str:
    return f"pred_{name}"


def score(
    points: DataFrame, models: Iterable[Model], keep: tuple[str, ...] = (), threshold: float = 0.5
) -> DataFrame:
    """``(keep..., pred_<model>..., label)`` in one narrow projection for all models.

    A row whose features do not match a model fails the query.
    """

    def prediction(model: Model) -> str:
        predicted = C.predicted_class(C.margin("features", model.weights, model.intercept), threshold)
        refusal = f"raise_error('model {model.name} needs {model.n_features} features, none of them NULL')"
        return f"coalesce({predicted}, CAST({refusal} AS INT)) AS {prediction_column(model.name)}"

    return points.selectExpr(*keep, *[prediction(m) for m in models], "label")
