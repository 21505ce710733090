"""Model folders as Spark's own classes write them."""

import json

import pytest

import prequenta as q
from prequenta.plans import online

MODEL = q.Model.of("warm", [0.5, -0.0, 1e-300, 3.25], 0.75)


def platform(spark, path, threshold=0.5, classes=2):
    """What another application would have saved."""
    mllib, jvm = spark._jvm.org.apache.spark.mllib, spark._jvm
    width = 3 * (classes - 1)
    weights = spark.sparkContext._gateway.new_array(jvm.double, width)
    for i in range(width):
        weights[i] = i / 4
    model = mllib.classification.LogisticRegressionModel(mllib.linalg.Vectors.dense(weights), 0.25 if classes == 2 else 0.0, 3, classes)
    model = model.clearThreshold() if threshold is None else model.setThreshold(threshold)
    model.save(spark.sparkContext._jsc.sc(), path)


def test_round_trip(spark, tmp_path):
    q.save_platform_model(spark, MODEL, f"{tmp_path}/m")
    loaded = q.load_platform_model(spark, f"{tmp_path}/m", "warm")
    assert loaded == MODEL and str(loaded.weights[1]) == "-0.0"
    about = json.loads(spark.read.text(f"{tmp_path}/m/metadata").first()[0])
    assert about == {
        "class": "org.apache.spark.mllib.classification.LogisticRegressionModel",
        "version": "1.0",
        "numFeatures": 4,
        "numClasses": 2,
    }
    with pytest.raises(Exception, match="already exists"):
        q.save_platform_model(spark, MODEL, f"{tmp_path}/m")


def test_a_folder_of_another_application(spark, tmp_path):
    platform(spark, f"{tmp_path}/m")
    loaded = q.load_platform_model(spark, f"{tmp_path}/m")
    assert loaded == q.Model.of("pretrained", [0.0, 0.25, 0.5], 0.25)


@pytest.mark.parametrize("options, message", [({"threshold": 0.7}, "threshold"), ({"threshold": None}, "threshold"), ({"classes": 3}, "3 classes")])
def test_models_that_decide_otherwise_are_refused(spark, tmp_path, options, message):
    platform(spark, f"{tmp_path}/m", **options)
    with pytest.raises(ValueError, match=message):
        q.load_platform_model(spark, f"{tmp_path}/m")


def test_both_kinds_of_folder_warm_start_the_online_job(spark, tmp_path):
    q.save_platform_model(spark, MODEL, f"{tmp_path}/platform")
    q.save_models(spark, [MODEL], f"{tmp_path}/table")
    for kind in ("platform", "table"):
        warm, cold = online.warm_and_cold(spark, f"{tmp_path}/{kind}", 4)
        assert (warm.name, warm.weights, warm.intercept) == ("pretrained", MODEL.weights, 0.75)
        assert cold == q.cold_model(n_features=4)
    with pytest.raises(ValueError, match="4 features"):
        online.warm_and_cold(spark, f"{tmp_path}/platform")


def test_a_model_of_more_classes_is_not_saved(spark, tmp_path):
    with pytest.raises(ValueError, match="not binary"):
        q.save_platform_model(spark, q.Model("m", (1.0,), 0.0, 0, 3), f"{tmp_path}/m")
