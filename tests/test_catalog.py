"""Every registered query against its SQL, and the plans the library promises."""

import contextlib
import io
import glob
import json
import math
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import prequenta as q
from prequenta.plans import catalog, fixtures, offline, online, serving

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    yield connection
    connection.close()


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr(tuple(v[i] for i in order)) for v in values)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    frame = contract.queries()[name](spark, sf_dir)
    result = duck.execute(contract.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows(frame.columns, [tuple(r) for r in frame.collect()]) == rows(columns, result.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_has_rows(spark, sf_dir, name):
    assert contract.queries()[name](spark, sf_dir).count() > 0


def test_entry(spark):
    values = {r["type"]: r["value"] for r in contract.entry(spark).collect()}
    assert set(values) == {"ACC pretrained", "ACC"} and values["ACC pretrained"] > values["ACC"]


def test_random_split_keeps_all_rows(spark, sf_dir):
    sides = catalog.query_random_split(spark, sf_dir)
    assert sides.count() == fixtures.table(spark, sf_dir, "lineitem").count()


def test_warm_starts_ahead_and_cold_catches_up(spark, sf_dir):
    series = q.running_accuracy(catalog.query_stream_prequential(spark, sf_dir)).collect()
    value = {(r["batch_id"], r["model"]): r["accuracy"] for r in series}
    assert value[0, "pretrained"] > value[0, "cold"]
    assert value[9, "pretrained"] - value[9, "cold"] < value[0, "pretrained"] - value[0, "cold"]


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_scoring_is_one_narrow_pass_over_the_needed_columns(spark, sf_dir):
    points = q.parse_labelled(fixtures.item_lines(spark, sf_dir), "line")
    plan = plan_of(q.confusion_counts(q.score(points, catalog.FIXED), catalog.NAMES))
    assert plan.count("Exchange") == 1 and "partial_count" in plan
    assert re.search(r"ReadSchema: struct<line:string>", plan)
    assert "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("models", [1, 2, 6])
def test_generated_methods_stay_compilable(spark, sf_dir, models):
    """The JVM interprets methods of more than 8000 bytes of bytecode."""
    names = [f"m{j}" for j in range(models)]
    fitted = [q.Model.of(name, [0.1 * j + 0.01 * k for k in range(30)]) for j, name in enumerate(names)]
    points = q.parse_labelled(fixtures.item_lines(spark, sf_dir), "line", keep=fixtures.ITEM_KEYS)
    scored = q.score(points, fitted, keep=fixtures.ITEM_KEYS)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for frame in (points, scored, q.confusion_counts(scored, names)):
            text = io.StringIO()
            with contextlib.redirect_stdout(text):
                frame.explain("codegen")
            sizes = [int(s) for s in re.findall(r"maxMethodCodeSize:(\d+)", text.getvalue())]
            assert sizes and max(sizes) <= 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_jobs_end_to_end(spark, sf_dir, tmp_path, capsys, monkeypatch):
    """Train from a headed file, stream a folder of lines, report, through the command lines."""
    monkeypatch.setattr(spark, "stop", lambda: None)
    csv, incoming = f"{tmp_path}/csv", f"{tmp_path}/incoming"
    items = q.named_rows(fixtures.item_lines(spark, sf_dir), fixtures.HEADER, "line")
    items.write.option("header", True).csv(csv)
    fixtures.stream_lines(spark, sf_dir).select("line").write.text(incoming)
    models, out = f"{tmp_path}/models", f"{tmp_path}/runs"

    for trainer in ("sgd", "lbfgs"):
        offline.main(["--input", csv, "--models", models, "--fraction", "0.2", "--split", "hash",
                      "--trainer", trainer, "--holdout"])
    saved = q.load_models(spark, models)["pretrained"]
    assert saved.version == 1 and saved.n_features == 30

    online.main(["--models", models, "--out", out, "--lines", incoming, "--available-now"])
    capsys.readouterr()
    serving.main(["--out", out, "--points", "3"])
    document = json.loads(capsys.readouterr().out.splitlines()[0])
    value = {o["type"]: o["value"] for o in document["output"]}
    assert value["ACC pretrained"] > value["ACC"] and not math.isnan(value["ACC"])


def test_saved_width_must_match_the_stream(spark, tmp_path):
    q.save_models(spark, [q.Model.of("pretrained", [1, 2])], f"{tmp_path}/m")
    with pytest.raises(ValueError, match="2 features"):
        online.warm_and_cold(spark, f"{tmp_path}/m")


def test_no_arbitrary_model_is_taken(spark, tmp_path):
    q.save_models(spark, [q.Model.of("a", [1, 2]), q.Model.of("b", [3, 4])], f"{tmp_path}/m")
    with pytest.raises(ValueError, match="not just one"):
        online.warm_and_cold(spark, f"{tmp_path}/m", 2)


def test_streams_leave_no_lines_behind(spark, sf_dir):
    counts = catalog.query_stream_confusion(spark, sf_dir)
    assert counts.select("batch_id").distinct().count() == catalog.BATCHES
    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    assert glob.glob(f"{shared}/prequenta/lines-*") == []


def test_lines_are_written_without_a_shuffle(spark, tmp_path):
    """The table has the files of its source, as many as a task wrote each, and the same lines."""
    rows = [(i, 1, i, i % 3, float(i)) for i in range(40)]
    source = spark.createDataFrame(rows, "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long, l_extendedprice double")
    for part in range(4):
        source.where(f"l_orderkey % 4 = {part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/lineitem.parquet")
    before = spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", str(128 << 20))
    try:
        lines = fixtures.item_lines(spark, str(tmp_path))
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", before)
    assert lines.count() == 40 and len(lines.inputFiles()) == 4


def test_lines_are_built_outside_generated_code(spark):
    """NULLs leave cells out, remainders keep their sign, and no long generated method holds the thirty features."""
    rows = [(1, 12345.675, 7, 3), (2, -0.5, -4, -2), (3, None, 7, 3), (4, 1.0, None, 3), (5, 901.0, 8, None), (6, 0.0, 0, 0), (7, 20.3, 5, 1)]
    table = spark.createDataFrame(rows, "id bigint, price double, shift bigint, noise int")
    cells = [F.expr(f"((c div {p}) + shift) % 3 - 1").alias(f"f{k}") for k, p in enumerate(fixtures.PRIMES, 1)]
    label = F.expr("if(f1 + 2 * f2 - f3 + (noise % 3 - 1) > 0, 1, -1)")
    plain = table.selectExpr("*", "cast(round(price * 100) as bigint) AS c").select("id", "noise", *cells)
    want = plain.select("id", F.concat_ws(",", *[f"f{k}" for k in range(1, 31)], label).alias("line"))
    lines = fixtures._planted(table, ("id",), "price", "shift", "noise")
    assert sorted(lines.collect()) == sorted(want.collect()) and len(rows) == lines.count()
    assert "concat_ws" not in lines._jdf.queryExecution().executedPlan().toString()
    huge = spark.createDataFrame([(1, 9e16, 2**63 - 1, 0)], table.schema)
    with pytest.raises(Exception):
        fixtures._planted(huge, ("id",), "price", "shift", "noise").collect()
