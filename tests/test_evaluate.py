import json

import pytest

import prequenta as q
from prequenta.model import PRETRAINED


@pytest.fixture
def points(spark):
    rows = [(1, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [0.0, 1.0]), (0, [1.0, 1.0])]
    return spark.createDataFrame(rows, "label int, features array<double>")


def counts_of(spark, rows):
    return spark.createDataFrame(rows, "model string, predicted int, actual int, n bigint")


def test_zero_margin_predicts_zero(points):
    scored = q.score(points, [q.cold_model(n_features=2)])
    assert {r["pred_cold"] for r in scored.collect()} == {0}


def test_models_side_by_side(points):
    models = [q.Model.of(PRETRAINED, [1, -1]), q.cold_model(n_features=2), q.Model.of("biased", [0, 0], 0.5)]
    scored = q.score(points, models)
    assert scored.columns == ["pred_pretrained", "pred_cold", "pred_biased", "label"]
    assert [tuple(r) for r in scored.collect()] == [(1, 0, 1, 1), (0, 0, 1, 0), (0, 0, 1, 1), (0, 0, 1, 0)]


def test_threshold(points):
    model = q.Model.of("m", [1, 0])
    assert [r[0] for r in q.score(points, [model], threshold=0.8).collect()] == [0, 0, 0, 0]
    assert [r[0] for r in q.score(points, [model], threshold=0.4).collect()] == [1, 1, 1, 1]


def test_extreme_weights_keep_their_value(points):
    tiny = q.Model.of("tiny", [1e-12, -3e-300])
    assert [r[0] for r in q.score(points, [tiny]).collect()] == [1, 0, 0, 1]
    huge = q.Model.of("huge", [-1e300, 1e300])
    assert [r[0] for r in q.score(points, [huge]).collect()] == [0, 1, 1, 0]


@pytest.mark.parametrize("features", [[1.0], [1.0, 2.0, 3.0], [1.0, None], None])
def test_features_that_do_not_match_fail(spark, features):
    bad = spark.createDataFrame([(1, features)], "label int, features array<double>")
    with pytest.raises(Exception, match="needs 2 features"):
        q.score(bad, [q.cold_model(n_features=2)]).collect()


def test_model_names_are_identifiers():
    with pytest.raises(ValueError):
        q.Model.of("a b", [1.0])


def test_confusion_counts_have_only_what_occurs(points):
    models = [q.Model.of(PRETRAINED, [1, -1]), q.cold_model(n_features=2)]
    counts = q.confusion_counts(q.score(points, models), ["pretrained", "cold"])
    assert sorted(tuple(r) for r in counts.collect()) == [
        ("cold", 0, 0, 2),
        ("cold", 0, 1, 2),
        ("pretrained", 0, 0, 2),
        ("pretrained", 0, 1, 1),
        ("pretrained", 1, 1, 1),
    ]
    keys = {r["key"]: r["n"] for r in q.counter_keys(counts).collect()}
    assert keys == {"0:0.0": 2, "0:1.0": 2, "0:0.0:pre": 2, "0:1.0:pre": 1, "1:1.0:pre": 1}


def test_no_true_positives_is_no_error(spark):
    counts = counts_of(spark, [("pretrained", 0, 0, 3), ("pretrained", 0, 1, 1), ("cold", 1, 1, 2)])
    assert {r["type"]: r["value"] for r in q.accuracy(counts).collect()} == {"ACC pretrained": 0.75, "ACC": 1.0}
    pivot = {r["model"]: tuple(r)[1:] for r in q.confusion_pivot(counts).collect()}
    assert pivot == {"pretrained": (0, 3, 0, 1), "cold": (2, 0, 0, 0)}


def test_no_counts_gives_null(spark):
    empty = counts_of(spark, [])
    assert [tuple(r) for r in q.accuracy(empty).collect()] == [("ACC pretrained", None), ("ACC", None)]
    document = json.loads(q.accuracy_json(empty).first()["json"])
    assert document == {"output": [{"type": "ACC pretrained", "value": None}, {"type": "ACC", "value": None}]}


def test_document_is_ordered(spark):
    counts = counts_of(spark, [("cold", 1, 1, 1), ("cold", 1, 0, 2), ("pretrained", 1, 1, 1)])
    document = json.loads(q.accuracy_json(counts).first()["json"])
    assert document == {"output": [{"type": "ACC pretrained", "value": 1.0}, {"type": "ACC", "value": 1 / 3}]}


def test_every_model_in_the_counts_is_reported(spark):
    rows = [("pretrained", 1, 1, 3), ("other", 0, 1, 1), ("other", 0, 0, 3), ("Another", 1, 1, 2)]
    counts = spark.createDataFrame(rows, "model string, predicted int, actual int, n bigint")
    want = [("ACC pretrained", 1.0), ("ACC", None), ("Another", 1.0), ("other", 0.75)]
    assert [tuple(r) for r in q.accuracy(counts).collect()] == want
    document = json.loads(q.accuracy_json(counts).first()["json"])
    assert [(r["type"], r["value"]) for r in document["output"]] == want
    assert [tuple(r) for r in q.accuracy(counts, ["other"]).collect()] == [("other", 0.75)]
