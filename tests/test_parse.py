import pytest

import prequenta as q
from prequenta.functions import cells as C
from prequenta.sources.text import read_header, read_labelled_csv, read_lines
from pyspark.sql import functions as F


def test_points(lines):
    parsed = q.parse_labelled(lines("1,0,-1,1", "5,6,7,-1"), n_features=3)
    assert [tuple(r) for r in parsed.collect()] == [(1, [1.0, 0.0, -1.0]), (0, [5.0, 6.0, 7.0])]
    assert dict(parsed.dtypes) == {"label": "int", "features": "array<double>"}


def test_blanks_and_signs_as_in_integers(lines):
    row = q.parse_labelled(lines(" 7, +2 ,-3\t,1"), n_features=3).first()
    assert row["features"] == [7.0, 2.0, -3.0]


def test_cells_beyond_32_bits(lines):
    assert q.parse_labelled(lines("3000000000,1"), n_features=1).first()["features"] == [3e9]


BAD = {
    "1,2,3,0": "label is neither -1 nor 1: 0",
    "1,2,3,2": "label is neither -1 nor 1: 2",
    "1,x,3,1": "a cell is no integer",
    "1,1.0,3,1": "a cell is no integer",
    "1,,3,1": "a cell is no integer",
    "1,2,3,": "a cell is no integer",
    "1,2,1": "cells in line: 3",
    "1,2,3,4,1": "cells in line: 5",
    "": "cells in line: 1",
}


@pytest.mark.parametrize("ansi", ["true", "false"])
@pytest.mark.parametrize("column", ["label", "features"])
@pytest.mark.parametrize("line", BAD)
def test_strict_mode_fails_whatever_is_read(spark, lines, line, column, ansi):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="USER_RAISED_EXCEPTION") as failure:
            q.parse_labelled(lines("1,2,3,1", line), n_features=3).select(column).collect()
        assert BAD[line] in str(failure.value)
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_permissive_mode_keeps_every_line(lines):
    parsed = q.parse_labelled(lines("1,2,3,1", *BAD), n_features=3, mode="permissive")
    good, bad = q.split_rejects(parsed)
    assert [tuple(r) for r in good.collect()] == [(1, [1.0, 2.0, 3.0])]
    assert {r["line"]: r["reject_reason"] for r in bad.collect()} == BAD


def test_unknown_mode(lines):
    with pytest.raises(ValueError):
        q.parse_labelled(lines("1,1"), n_features=1, mode="lenient")


def test_label_outside_the_domain_is_named(spark):
    raw = spark.createDataFrame([(-1,), (1,)], "l bigint")
    assert [r[0] for r in raw.select(C.encode_label(F.col("l"))).collect()] == [0, 1]
    with pytest.raises(Exception, match="neither -1 nor 1: 3"):
        spark.createDataFrame([(3,)], "l bigint").select(C.encode_label(F.col("l"))).collect()


def test_header_is_dropped_by_its_first_cell(lines):
    df = lines("a,b,label", "1,2,1", "a,9,-1", "3,4,-1")
    assert [r[0] for r in q.drop_header(df, "a,b,label").collect()] == ["1,2,1", "3,4,-1"]


def test_headed_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text("a,b,label\n1,2,1\n3,4,-1\n")
    (tmp_path / "two.csv").write_text("a,b,label\n5,6,1\n")
    assert read_header(spark, str(tmp_path)) == ["a", "b", "label"]
    assert read_lines(spark, str(tmp_path)).count() == 5
    rows = read_labelled_csv(spark, str(tmp_path), n_features=2).collect()
    assert sorted((r["label"], r["features"]) for r in rows) == [(0, [3.0, 4.0]), (1, [1.0, 2.0]), (1, [5.0, 6.0])]


def test_named_rows(lines):
    df = q.named_rows(lines("1,2,-1"), "a,b,label")
    assert df.columns == ["a", "b", "label"] and tuple(df.first()) == (1, 2, -1)
    for bad in ("1,x,1", "1,1", "1,2,3,1"):
        with pytest.raises(Exception, match="not a row of integers"):
            q.named_rows(lines(bad), "a,b,label").select("a").collect()


def test_payload_strips_blanks_and_encodes(lines):
    rows = q.publish_payload(lines(" \t1,2,1\r\n", "é,1 ")).collect()
    assert [bytes(r["value"]) for r in rows] == [b"1,2,1", "é,1".encode("utf8")]


def test_header_cells_are_taken_as_they_stand(spark, tmp_path):
    (tmp_path / "q.csv").write_text('"a","a",label\n1,2,1\n')
    assert read_header(spark, str(tmp_path)) == ['"a"', '"a"', "label"]
    assert read_labelled_csv(spark, str(tmp_path), n_features=2).first()["features"] == [1.0, 2.0]
    (tmp_path / "empty").mkdir()
    (tmp_path / "empty" / "e.csv").write_text("")
    with pytest.raises(ValueError, match="no header"):
        read_header(spark, str(tmp_path / "empty"))


def test_wide_records(spark):
    line = ",".join(["1"] * 300 + ["-1"])
    df = spark.createDataFrame([(line,)], "value string")
    points = q.parse_labelled(df, n_features=300)
    scored = q.score(points, [q.Model.of(f"m{j}", [0.01 * j - 0.02] * 300) for j in range(4)])
    assert tuple(scored.first()) == (0, 0, 0, 1, 0)


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_null_lines_are_kept_and_rejected(spark, lines, ansi):
    frame = q.drop_header(lines("a,b", None, "1,1"), "a,b")
    assert frame.count() == 2
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        rejected = q.parse_labelled(frame, n_features=1, mode="permissive").where("reject_reason IS NOT NULL").collect()
        assert [(r["line"], r["reject_reason"]) for r in rejected] == [(None, "no line")]
        with pytest.raises(Exception, match="no line in line: NULL"):
            q.parse_labelled(frame, n_features=1).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def test_header_cannot_fail_a_filter_that_uses_the_features_twice(spark, tmp_path):
    path = f"{tmp_path}/headed"
    spark.createDataFrame([("a,b,label\n1,2,1\n3,4,-1",)], "value string").coalesce(1).write.text(path)
    points = q.read_labelled_csv(spark, path, n_features=2)
    kept = points.where("features[0] * features[1] > 1 AND features[0] + features[1] < 100")
    assert sorted(r["label"] for r in kept.collect()) == [0, 1]
