"""Versioned model tables, and the model folders that Spark itself writes."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prequenta.model import MODEL_SCHEMA, PRETRAINED, Model
from prequenta.session import list_folder

THRESHOLD = 0.5


def _models_frame(spark: SparkSession, models: Iterable[Model]) -> DataFrame:
    """The models as a literal table: planned on the driver, written by one small task."""
    return spark.sql(f"SELECT * FROM VALUES {', '.join(m.as_sql() for m in models)} AS t({', '.join(MODEL_SCHEMA.names)})")


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """All versions of all models in the table."""
    return spark.read.schema(MODEL_SCHEMA).parquet(path)


def load_models(spark: SparkSession, path: str, before: int | None = None) -> dict[str, Model]:
    """The latest version of each model, or the latest below ``before``.

    What is collected has the size of the set of models, not of their versions.
    """
    stored = read_models(spark, path)
    if before is not None:
        stored = stored.where(F.col("version") < before)
    newest = F.max_by(F.struct("*"), "version").alias("row")
    rows = stored.groupBy("model").agg(newest).select("row.*").collect()
    return {row["model"]: Model.from_row(row) for row in rows}


def save_models(
    spark: SparkSession, models: Iterable[Model], path: str, version: int | None = None
) -> int:
    """Write models under one version, by default one above the table's highest."""
    if version is None:
        try:
            newest = read_models(spark, path).agg(F.max("version")).first()[0]
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            newest = None
        version = 0 if newest is None else newest + 1
    (
        _models_frame(spark, [m.at_version(version) for m in models])
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("version")
        .parquet(path)
    )
    return version


def is_platform_model(spark: SparkSession, path: str) -> bool:
    """Whether the folder is a model as Spark's ``LogisticRegressionModel.save`` writes it, and no model table."""
    return {"metadata", "data"} <= set(list_folder(spark, path))


def save_platform_model(spark: SparkSession, model: Model, path: str) -> None:
    """Save as Spark's own classes do: a line of JSON in ``metadata``, the weights as Parquet in ``data``.

    The folder must not exist. It has no place for the name and the version.
    """
    if model.n_classes != 2:
        raise ValueError(f"a model of {model.n_classes} classes is not binary")
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    weights = gateway.new_array(jvm.double, model.n_features)
    for i, weight in enumerate(model.weights):
        weights[i] = float(weight)
    mllib = jvm.org.apache.spark.mllib
    stored = mllib.classification.LogisticRegressionModel(mllib.linalg.Vectors.dense(weights), float(model.intercept))
    stored.save(spark.sparkContext._jsc.sc(), path)


def load_platform_model(spark: SparkSession, path: str, name: str = PRETRAINED) -> Model:
    """The model in a folder that ``LogisticRegressionModel.save`` wrote, under a name.

    A model of more than two classes is refused, and so is one that decides elsewhere than
    above one half, as this library's models do.
    """
    stored = spark._jvm.org.apache.spark.mllib.classification.LogisticRegressionModel.load(spark.sparkContext._jsc.sc(), path)
    if stored.numClasses() != 2:
        raise ValueError(f"the model in {path} has {stored.numClasses()} classes, not 2")
    threshold = stored.getThreshold()
    if threshold.isEmpty() or threshold.get() != THRESHOLD:
        raise ValueError(f"the model in {path} has the threshold {threshold}, not {THRESHOLD}")
    return Model.of(name, stored.weights().toArray(), stored.intercept())


def load_any(spark: SparkSession, path: str) -> dict[str, Model]:
    """The latest models of a model table, or the one model of a platform folder."""
    if is_platform_model(spark, path):
        model = load_platform_model(spark, path)
        return {model.name: model}
    return load_models(spark, path)
