from types import SimpleNamespace

import pytest

from prequenta.session import drop_folder, shared_folder


def session(folder):
    conf = {"spark.checkpoint.dir": folder, "spark.sql.warehouse.dir": "s3a://store/warehouse"}
    return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: conf[key] or default))


def test_the_named_folder_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first.startswith(named) and first != second
    assert shared_folder(session("hdfs:///shared/"), "x").startswith("hdfs:///shared/prequenta/x-")


def test_else_it_lies_below_the_warehouse():
    assert shared_folder(session(None), "x").startswith("s3a://store/warehouse/intermediate/prequenta/x-")


def test_drop_folder(spark):
    path = shared_folder(spark, "x")
    spark.range(3).write.parquet(path)
    drop_folder(spark, path)
    drop_folder(spark, path)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        spark.read.parquet(path)
