"""Every operator as a query over the given tables, with the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import replace
from datetime import timedelta

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prequenta.functions import cells as C
from prequenta.model import COLD, N_FEATURES, PRETRAINED, Model, cold_model
from prequenta.operators.evaluate import accuracy, accuracy_json, confusion_counts, confusion_pivot, counter_keys
from prequenta.operators.fit import OFFLINE, ONLINE, SgdSettings, held_points, lbfgs_fit, optimality, sgd_fit
from prequenta.operators.parse import drop_header, named_rows, parse_labelled, publish_payload, split_rejects
from prequenta.operators.report import POINTS, as_of, last_points, running_accuracy
from prequenta.operators.score import score
from prequenta.operators.split import TRAIN_FRACTION, bootstrap_sample, hash_split, in_train_share, random_split
from prequenta.plans import fixtures as X
from prequenta.plans import oracle as O
from prequenta.plans.offline import holdout_confusion, train_offline
from prequenta.session import drop_folder, shared_folder
from prequenta.sources.counts import CountTable
from prequenta.sources.models import load_models, load_platform_model, read_models, save_models, save_platform_model
from prequenta.sources.text import read_labelled_csv, read_lines
from prequenta.sources.text import stream_lines as stream_text
from prequenta.streaming.prequential import Run, open_run, read_counts, read_progress, read_rejects, read_totals, run_prequential

# Weights for the queries that check scoring alone: the planted rule and some small
# terms. All are multiples of 1/8, so margins are exact in any order of summation.
RULE = Model.of(
    PRETRAINED, [0.75, 1.5, -0.75] + [0.125 if k % 2 else -0.125 for k in range(3, N_FEATURES)]
)
FIXED = (RULE, cold_model())
NAMES = [m.name for m in FIXED]
WARM_INTERCEPT = 0.5
L1_PENALTY = 0.02
RESET_BATCHES = 3
EMPTY_BATCH = 4
TICKS = 62
TICK_HOURS = 12
BATCHES = 10
REPORT_BATCHES = 50
TEST_FRACTION = 0.2
TEN_STEPS = SgdSettings(iterations=10, step=1.0, reg_param=0.01, tol=0.0)
FIRST_STEP = SgdSettings(iterations=1, step=1.0, reg_param=0.0, tol=0.0)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function ``query_<name>`` as the query ``<name>``, with its SQL if it has any."""

    def register(function: Query) -> Query:
        name = function.__name__.removeprefix("query_")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


# Inputs.


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_labelled(X.item_lines(spark, sf_dir), "line", keep=X.ITEM_KEYS)


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_labelled(X.stream_lines(spark, sf_dir), "line", keep=("event_id",))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_labelled(X.vector_lines(spark, sf_dir), "line", X.VECTOR_FEATURES, keep=("vec_id",))


def _batch_counts(spark: SparkSession, sf_dir: str, batches: int) -> DataFrame:
    width = X.batch_width(spark, sf_dir, batches)
    scored = X.with_batch(score(_stream(spark, sf_dir), FIXED, keep=("event_id",)), width)
    return confusion_counts(scored, NAMES, by=("batch_id",))


def _cells_text(features: str = "features"):
    return F.concat_ws(" ", F.col(features).cast("array<bigint>").cast("array<string>"))


def _weight_rows(spark: SparkSession, models: Iterable[Model]) -> DataFrame:
    """``(model, k, weight)``; as many rows as the models have weights."""
    rows = [(m.name, k, w) for m in models for k, w in enumerate(m.weights, 1)]
    frame = spark.createDataFrame(rows, "model string, k bigint, weight double")
    return frame.select("model", "k", F.round("weight", 6).alias("weight"))


def feed_micro_batches(
    spark: SparkSession,
    sf_dir: str,
    stream: Callable[[DataFrame], StreamingQuery],
    batches: int = BATCHES,
    line: Column | None = None,
) -> None:
    """Let the event lines arrive as text, batch after batch, and run ``stream`` to its end on each.

    A batch is what a run finds, whatever the number of its files and their times, so the
    result does not depend on the cluster. The range of ids of a batch is pushed down.
    """
    lines = X.stream_lines(spark, sf_dir)
    if line is not None:
        lines = lines.withColumn("line", line)
    width = X.batch_width(spark, sf_dir, batches)
    path = shared_folder(spark, "lines")
    for batch in range(batches):
        ids = F.col("event_id").between(batch * width, (batch + 1) * width - 1)
        lines.where(ids).select("line").write.mode("append").text(path)
        stream(stream_text(spark, path)).awaitTermination()
    drop_folder(spark, path)


# Sources and parsing.


@_query(O.with_sql(O.ITEMS_SQL) + f" SELECT label, {O.CELLS_SQL} AS cells FROM items")
def query_scan_labelled_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "csv")
    named = named_rows(X.item_lines(spark, sf_dir), X.HEADER, "line")
    named.write.option("header", True).csv(path)
    return read_labelled_csv(spark, path).select("label", _cells_text().alias("cells"))


@_query(
    O.with_sql(
        O.STREAM_SQL,
        f"""lines AS (SELECT event_id, {O.LINE_SQL} AS line FROM stream
                      UNION ALL SELECT NULL, '{X.HEADER}' FROM events WHERE event_type = 'purchase')""",
    )
    + " SELECT event_id, line FROM lines WHERE split_part(line, ',', 1) <> 'f1'"
)
def query_header_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    # One header per purchase event stands for the headers of many concatenated files.
    headers = X.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        F.lit(None).cast("bigint").alias("event_id"), F.lit(X.HEADER).alias("line")
    )
    return drop_header(X.stream_lines(spark, sf_dir).unionByName(headers), X.HEADER, "line")


@_query(
    O.with_sql(O.STREAM_SQL, f"cut AS (SELECT event_id, string_split({O.LINE_SQL}, ',') AS c FROM stream)")
    + " SELECT event_id, len(c) AS n_cells, c[1] AS first_cell, c[len(c)] AS last_cell,"
    " array_to_string(c, '|') AS cells FROM cut"
)
def query_parse_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = X.stream_lines(spark, sf_dir).select("event_id", C.split_cells(F.col("line")).alias("c"))
    return cut.select(
        "event_id",
        F.size("c").cast("bigint").alias("n_cells"),
        F.element_at("c", 1).alias("first_cell"),
        F.element_at("c", -1).alias("last_cell"),
        F.concat_ws("|", "c").alias("cells"),
    )


@_query(
    O.with_sql(O.STREAM_SQL, f"cut AS (SELECT event_id, string_split({O.LINE_SQL}, ',') AS c FROM stream)")
    + """ SELECT event_id, CAST(len(c) AS BIGINT) AS n_cells,
          array_to_string(list_transform(c, lambda s: CAST(s AS BIGINT) * 10), ' ') AS tens FROM cut"""
)
def query_parse_int_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    ints = X.stream_lines(spark, sf_dir).select("event_id", C.int_cells(C.split_cells(F.col("line"))).alias("c"))
    tens = F.transform("c", lambda x: x * 10).cast("array<string>")
    return ints.select("event_id", F.size("c").cast("bigint").alias("n_cells"), F.concat_ws(" ", tens).alias("tens"))


@_query(
    O.with_sql(O.STREAM_SQL) + " SELECT event_id, CAST(2 * label - 1 AS BIGINT) AS raw_label, label FROM stream"
)
def query_label_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = C.int_cells(C.split_cells(F.col("line")))
    raw = X.stream_lines(spark, sf_dir).select("event_id", F.element_at(cells, -1).alias("raw_label"))
    return raw.select("event_id", "raw_label", C.encode_label(F.col("raw_label")).alias("label"))


@_query(O.with_sql(O.VECTORS_SQL) + f" SELECT vec_id, label, {O.CELLS_SQL} AS cells FROM vectors")
def query_labelled_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vectors(spark, sf_dir).select("vec_id", "label", _cells_text().alias("cells"))


@_query(
    O.with_sql(O.STREAM_SQL)
    + " SELECT event_id, "
    + ", ".join(f"f[{k}] AS f{k}" for k in range(1, N_FEATURES + 1))
    + ", CAST(2 * label - 1 AS BIGINT) AS label FROM stream"
)
def query_named_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return named_rows(X.stream_lines(spark, sf_dir), X.HEADER, "line", keep=("event_id",))


@_query(
    O.with_sql(
        O.STREAM_SQL,
        f"""spoilt AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN replace({O.LINE_SQL}, '1', 'x')
                              ELSE {O.LINE_SQL} END AS line FROM stream)""",
    )
    + """ SELECT event_id, CASE WHEN regexp_full_match(line, '(-?[0-9]+,)*-?[0-9]+') THEN 'good' ELSE 'rejected' END
          AS verdict FROM spoilt"""
)
def query_parse_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoilt = X.stream_lines(spark, sf_dir).select(
        "event_id",
        F.when(F.col("event_id") % 3 == 0, F.replace("line", F.lit("1"), F.lit("x"))).otherwise(F.col("line")).alias("line"),
    )
    good, bad = split_rejects(parse_labelled(spoilt, "line", mode="permissive", keep=("event_id",)))
    return good.select("event_id", F.lit("good").alias("verdict")).unionByName(
        bad.select("event_id", F.lit("rejected").alias("verdict"))
    )


@_query(
    O.with_sql(O.STREAM_SQL, f"padded AS (SELECT event_id, '  ' || {O.LINE_SQL} || chr(9) || ' ' AS line FROM stream)")
    + """ SELECT event_id, hex(encode(trim(line, ' ' || chr(9)))) AS payload FROM padded"""
)
def query_publish_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    padded = X.stream_lines(spark, sf_dir).select(
        "event_id", F.concat(F.lit("  "), F.col("line"), F.lit("\t ")).alias("line")
    )
    return publish_payload(padded, "line", keep=("event_id",)).select("event_id", F.hex("value").alias("payload"))


# Sampling.


@_query(
    O.with_sql(O.ITEMS_SQL)
    + f" SELECT {O.ITEM_KEY_SQL}, CASE WHEN {O.in_train_sql(X.ITEM_KEYS, TEST_FRACTION)} THEN 'train' ELSE 'rest' END AS side"
    " FROM items"
)
def query_hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = list(X.ITEM_KEYS)
    train, rest = hash_split(X.table(spark, sf_dir, "lineitem").select(*keys), keys, TEST_FRACTION)
    return train.withColumn("side", F.lit("train")).unionByName(rest.withColumn("side", F.lit("rest")))


@_query(f"SELECT {O.ITEM_KEY_SQL}, true AS in_bounds FROM lineitem")
def query_random_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows of both sides, and whether the share is within six standard deviations of what was asked for."""
    train, rest = random_split(X.item_lines(spark, sf_dir).select(*X.ITEM_KEYS))
    sides = train.withColumn("in_train", F.lit(True)).unionByName(rest.withColumn("in_train", F.lit(False)))
    rows, chosen = sides.agg(F.count("*"), F.count_if("in_train")).first()
    spread = 6 * (rows * TRAIN_FRACTION * (1 - TRAIN_FRACTION)) ** 0.5
    return sides.select(*X.ITEM_KEYS, F.lit(abs(chosen - rows * TRAIN_FRACTION) <= spread).alias("in_bounds"))


@_query(
    O.with_sql(O.STREAM_SQL, O.scattered_sql("placed", "stream", ("event_id",)), f"drawn AS (SELECT *, {O.draws_sql(1.0)} AS times FROM placed)")
    + f" SELECT event_id, {O.LINE_SQL} AS line, CAST(unnest(range(1, times + 1)) AS INTEGER) AS draw FROM drawn"
)
def query_bootstrap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bootstrap_sample(X.stream_lines(spark, sf_dir), keys=["event_id"])


# Prediction and evaluation.


@_query(
    O.with_sql(O.ITEMS_SQL)
    + f" SELECT {O.ITEM_KEY_SQL}, {O.predict_sql(O.list_sql(RULE.weights))} AS pred_pretrained, label FROM items"
)
def query_predict_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_items(spark, sf_dir), [RULE], keep=X.ITEM_KEYS)


@_query(
    O.with_sql(O.STREAM_SQL)
    + f" SELECT event_id, {O.predict_sql(O.list_sql(RULE.weights))} AS pred_pretrained,"
    f" {O.predict_sql(O.ZEROS_SQL)} AS pred_cold, label FROM stream"
)
def query_score_two_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_stream(spark, sf_dir), FIXED, keep=("event_id",))


@_query(
    O.with_sql(
        O.ITEMS_SQL,
        f"held AS (SELECT * FROM items WHERE NOT ({O.in_train_sql(X.ITEM_KEYS, TRAIN_FRACTION)}))",
        O.scored_sql("held", (RULE,), ()),
        O.counts_sql(),
    )
    + " SELECT * FROM counts"
)
def query_holdout_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rest = hash_split(_items(spark, sf_dir), list(X.ITEM_KEYS))
    return holdout_confusion(rest, RULE)


@_query(O.with_sql(O.ITEMS_SQL, O.scored_sql("items", FIXED, ()), O.counts_sql()) + " SELECT * FROM counts")
def query_confusion_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion_counts(score(_items(spark, sf_dir), FIXED), NAMES)


_ITEM_COUNTS = O.with_sql(O.ITEMS_SQL, O.scored_sql("items", FIXED, ()), O.counts_sql())


@_query(
    _ITEM_COUNTS
    + """ SELECT model, CAST(sum(CASE WHEN predicted = 1 AND actual = 1 THEN n ELSE 0 END) AS BIGINT) AS tp,
                 CAST(sum(CASE WHEN predicted = 0 AND actual = 0 THEN n ELSE 0 END) AS BIGINT) AS tn,
                 CAST(sum(CASE WHEN predicted = 1 AND actual = 0 THEN n ELSE 0 END) AS BIGINT) AS fp,
                 CAST(sum(CASE WHEN predicted = 0 AND actual = 1 THEN n ELSE 0 END) AS BIGINT) AS fn
          FROM counts GROUP BY model"""
)
def query_confusion_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion_pivot(query_confusion_counts(spark, sf_dir))


@_query(_ITEM_COUNTS + f" SELECT {O.counter_key_sql()} AS key, n FROM counts")
def query_counter_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counter_keys(query_confusion_counts(spark, sf_dir))


@_query(_ITEM_COUNTS + " " + O.accuracy_sql())
def query_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy(query_confusion_counts(spark, sf_dir)).select("type", F.round("value", 6).alias("value"))


@_query(
    O.with_sql(
        O.ITEMS_SQL, O.scored_sql("items", FIXED, ()), O.counts_sql(), f"acc AS ({O.accuracy_sql()})"
    )
    + """ SELECT '{"output":[' || string_agg('{"type":"' || type || '","value":' || CAST(value AS VARCHAR) || '}', ','
                 ORDER BY CASE type WHEN 'ACC pretrained' THEN 0 ELSE 1 END) || ']}' AS json FROM acc"""
)
def query_accuracy_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return accuracy_json(query_confusion_counts(spark, sf_dir), decimals=6)


# Fitting.


@_query(
    O.with_sql(O.ITEMS_SQL)
    + " SELECT 'cold' AS model, k, round(-avg((0.5 - label) * f[k]), 6) AS weight"
    f" FROM items, range(1, {N_FEATURES + 1}) AS r(k) GROUP BY k"
)
def query_sgd_first_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = sgd_fit(_items(spark, sf_dir), [cold_model()], FIRST_STEP)
    return _weight_rows(spark, fitted.values())


@_query(
    O.with_sql(
        O.ITEMS_SQL,
        O.points_sql("pts", "items"),
        O.start_sql("s0", {COLD: O.ZEROS_SQL}),
        O.fit_sql("fit", "pts", "s0", TEN_STEPS),
        recursive=True,
    )
    + " "
    + O.weights_out_sql("fit")
)
def query_sgd_fit_10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weight_rows(spark, sgd_fit(_items(spark, sf_dir), [cold_model()], TEN_STEPS).values())


@_query(
    O.with_sql(
        O.STREAM_SQL,
        O.points_sql("pts", "stream"),
        O.start_sql("s0", {PRETRAINED: O.list_sql(RULE.weights), COLD: O.ZEROS_SQL}),
        O.fit_sql("fit", "pts", "s0", ONLINE),
        recursive=True,
    )
    + " "
    + O.weights_out_sql("fit")
)
def query_warm_start_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "models")
    save_models(spark, [Model.of(name, [9.0] * N_FEATURES) for name in NAMES], path)
    save_models(spark, FIXED, path)  # the newer version is the one to load
    start = load_models(spark, path).values()
    return _weight_rows(spark, sgd_fit(_stream(spark, sf_dir), start, ONLINE).values())


@_query(
    O.with_sql(
        O.STREAM_SQL,
        O.points_sql("pts", "stream"),
        O.points_sql("pts1", "stream", constant=True),
        O.start_sql("s0", {COLD: O.ZEROS_SQL}),
        O.start_sql("s1", {PRETRAINED: O.list_sql([*RULE.weights, WARM_INTERCEPT])}),
        O.fit_sql("fit", "pts", "s0", ONLINE),
        O.fit_sql("fit1", "pts1", "s1", ONLINE, N_FEATURES + 1),
        recursive=True,
    )
    + f""" SELECT model, k % {N_FEATURES + 1} AS k, weight FROM ({O.weights_out_sql("fit1", N_FEATURES + 1)})
           UNION ALL {O.weights_out_sql("fit")} UNION ALL SELECT '{COLD}', 0, 0.0"""
)
def query_warm_start_intercept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model that starts with an intercept learns it (``k`` = 0), one that starts without does not."""
    start = [replace(RULE, intercept=WARM_INTERCEPT), cold_model()]
    fitted = sgd_fit(_stream(spark, sf_dir), start, ONLINE).values()
    intercepts = spark.createDataFrame([(m.name, 0, m.intercept) for m in fitted], "model string, k bigint, weight double")
    return _weight_rows(spark, fitted).unionByName(intercepts.withColumn("weight", F.round("weight", 6)))


_OFFLINE_FIT = (
    O.ITEMS_SQL,
    O.points_sql("train", "items", where=O.in_train_sql(X.ITEM_KEYS, TRAIN_FRACTION)),
    O.start_sql("s0", {PRETRAINED: O.ZEROS_SQL}),
    O.fit_sql("offline", "train", "s0", OFFLINE),
)


@_query(
    O.with_sql(
        *_OFFLINE_FIT,
        f"""scored AS (SELECT model, {O.predict_sql("w")} AS predicted, label AS actual FROM items, offline
                       WHERE NOT ({O.in_train_sql(X.ITEM_KEYS, TRAIN_FRACTION)}))""",
        O.counts_sql(),
        recursive=True,
    )
    + " SELECT * FROM counts"
)
def query_offline_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, rest = train_offline(_items(spark, sf_dir), list(X.ITEM_KEYS))
    return holdout_confusion(rest, model)


def _optimum_query(reg_param: float) -> str:
    parts = (O.ITEMS_SQL, O.points_sql("pts", "items"), O.optimum_sql("best", "pts", reg_param))
    residual = "CASE WHEN weight = 0 THEN greatest(abs(slope) - bound, 0) ELSE abs(slope + sign(weight) * bound) END"
    return O.with_sql(*parts, recursive=True) + (
        f" SELECT 'lbfgs' AS model, k, round(weight, 4) + 0.0 AS weight, weight = 0 AS idle, round({residual}, 5) + 0.0 AS residual FROM best_listed"
    )


def _certified(points: DataFrame, reg_param: float) -> DataFrame:
    with held_points(points) as held:
        model = lbfgs_fit(held, reg_param=reg_param, tol=1e-12, max_iter=500)
        rows = optimality(held, model, reg_param)
    weight, residual = F.round("weight", 4) + F.lit(0.0), F.round("residual", 5) + F.lit(0.0)
    return rows.select(F.lit(model.name).alias("model"), "k", weight.alias("weight"), (F.col("weight") == 0).alias("idle"), residual.alias("residual"))


@_query(_optimum_query(0.0))
def query_lbfgs_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quasi-Newton fit and, per weight, how far it is from the conditions of the optimum."""
    return _certified(_items(spark, sf_dir), 0.0)


@_query(_optimum_query(L1_PENALTY))
def query_lbfgs_penalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with an L1 penalty, which leaves weights at 0 that have nothing to say."""
    return _certified(_items(spark, sf_dir), L1_PENALTY)


@_query(
    O.with_sql(O.VECTORS_SQL)
    + f""" SELECT 'cold' AS model, CAST(0 AS BIGINT) AS version, k,
                  round(0.0::DOUBLE - avg((0.5 - label) * f[k]), 6) + 0.0::DOUBLE AS weight, 0.0::DOUBLE AS intercept,
                  {X.VECTOR_FEATURES} AS n_features, 2 AS n_classes
           FROM vectors, range(1, {X.VECTOR_FEATURES + 1}) AS r(k) GROUP BY k"""
)
def query_model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "models")
    save_models(spark, sgd_fit(_vectors(spark, sf_dir), [cold_model(n_features=X.VECTOR_FEATURES)], FIRST_STEP).values(), path)
    stored = read_models(spark, path).select("*", F.posexplode("weights").alias("pos", "w"))
    return stored.select(
        "model",
        "version",
        (F.col("pos") + 1).cast("bigint").alias("k"),
        F.round("w", 6).alias("weight"),
        "intercept",
        "n_features",
        "n_classes",
    )


@_query(
    O.with_sql(O.VECTORS_SQL)
    + f""" , fitted AS (SELECT k, round(0.0::DOUBLE - avg((0.5 - label) * f[k]), 6) + 0.0::DOUBLE AS weight
                        FROM vectors, range(1, {X.VECTOR_FEATURES + 1}) AS r(k) GROUP BY k)
           SELECT 'org.apache.spark.mllib.classification.LogisticRegressionModel' AS class, '1.0' AS version,
                  CAST({X.VECTOR_FEATURES} AS BIGINT) AS n_features, CAST(2 AS BIGINT) AS n_classes, k, weight AS stored, weight AS loaded,
                  0.0::DOUBLE AS intercept, 0.5::DOUBLE AS threshold FROM fitted"""
)
def query_platform_model_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted model saved as Spark's own classes do: what its files hold, and what is loaded from them."""
    path = shared_folder(spark, "platform-model")
    fitted = sgd_fit(_vectors(spark, sf_dir), [cold_model(n_features=X.VECTOR_FEATURES)], FIRST_STEP)[COLD]
    save_platform_model(spark, fitted, path)
    about = spark.read.schema("class string, version string, numFeatures bigint, numClasses bigint").json(f"{path}/metadata")
    files = spark.read.parquet(f"{path}/data").select(F.posexplode(vector_to_array("weights")).alias("pos", "w"), "intercept", "threshold")
    loaded = _weight_rows(spark, [load_platform_model(spark, path)]).select("k", F.col("weight").alias("loaded"))
    stored = files.select((F.col("pos") + 1).cast("bigint").alias("k"), (F.round("w", 6) + 0.0).alias("stored"), "intercept", "threshold")
    return stored.join(loaded.withColumn("loaded", F.col("loaded") + 0.0), "k").join(
        about.select("class", "version", F.col("numFeatures").alias("n_features"), F.col("numClasses").alias("n_classes")), how="cross"
    )


# Streams.


@_query(O.with_sql(O.STREAM_SQL) + f" SELECT label, {O.CELLS_SQL} AS cells FROM stream")
def query_stream_scan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, checkpoint = shared_folder(spark, "parsed"), shared_folder(spark, "checkpoint")

    def scan(lines: DataFrame) -> StreamingQuery:
        parsed = parse_labelled(lines).select("label", _cells_text().alias("cells"))
        sink = parsed.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint)
        return sink.trigger(availableNow=True).start()

    feed_micro_batches(spark, sf_dir, scan)
    return spark.read.parquet(out)


def _streamed(spark: SparkSession, sf_dir: str, models: Iterable[Model], train: bool, batches: int = BATCHES, **options) -> Run:
    run, start = open_run(spark, shared_folder(spark, "online"), **options), list(models)
    feed_micro_batches(spark, sf_dir, lambda lines: run_prequential(lines, start, run, train=train, available_now=True), batches)
    return run


def _streamed_counts(
    spark: SparkSession, sf_dir: str, models: Iterable[Model], train: bool
) -> DataFrame:
    return read_counts(spark, _streamed(spark, sf_dir, models, train))


def _stream_counts_sql(batches: int = BATCHES) -> str:
    parts = O.stream_batches_sql(batches), O.scored_sql("batched", FIXED, ("batch_id",)), O.counts_sql(("batch_id",))
    return O.with_sql(O.STREAM_SQL, *parts)


@_query(_stream_counts_sql() + " SELECT * FROM counts")
def query_stream_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _streamed_counts(spark, sf_dir, FIXED, train=False)


@_query(_stream_counts_sql() + " SELECT * FROM counts")
def query_stream_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts from eras of three batches, closed and rewritten while the stream goes on."""
    return read_counts(spark, _streamed(spark, sf_dir, FIXED, train=False, batches_per_era=3))


@_query(_stream_counts_sql(7) + " SELECT model, predicted, actual, CAST(sum(n) AS BIGINT) AS n FROM counts GROUP BY ALL")
def query_stream_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals from the snapshot of the last closed era and the batches after it."""
    return read_totals(spark, _streamed(spark, sf_dir, FIXED, train=False, batches=7, batches_per_era=2))


@_query(_stream_counts_sql(RESET_BATCHES) + " SELECT r.run, counts.* FROM counts, (VALUES ('first'), ('second')) AS r(run)")
def query_run_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reset starts from nothing and leaves the counts of the run before as they are."""
    out, found = shared_folder(spark, "online"), []
    for name, reset in (("first", False), ("second", True)):
        run = open_run(spark, out, reset)
        feed_micro_batches(spark, sf_dir, lambda lines, run=run: run_prequential(lines, FIXED, run, train=False, available_now=True), RESET_BATCHES)
        found.append((name, run))
    both = [read_counts(spark, run).withColumn("run", F.lit(name)) for name, run in found]
    return both[0].unionByName(both[1])


# Lines with letters for digits, with a cell too many, and with a label that is none.
_SPOILT_SQL = """CASE WHEN event_id % 5 = 0 THEN replace(line, '0', 'x') WHEN event_id % 7 = 0 THEN line || ',1'
                      WHEN event_id % 11 = 0 THEN regexp_replace(line, ',[^,]*$', ',0') ELSE line END"""


@_query(
    O.with_sql(
        O.STREAM_SQL,
        O.stream_batches_sql(BATCHES),
        f"whole AS (SELECT *, {O.LINE_SQL} AS line FROM batched)",
        f"cut AS (SELECT *, string_split(spoilt, ',') AS cells FROM (SELECT *, {_SPOILT_SQL} AS spoilt FROM whole))",
        f"""judged AS (SELECT *, CASE WHEN len(cells) <> {N_FEATURES + 1} THEN 'cells in line: ' || len(cells)
                           WHEN NOT regexp_full_match(spoilt, '(-?[0-9]+,)*-?[0-9]+') THEN 'a cell is no integer'
                           WHEN cells[-1] NOT IN ('-1', '1') THEN 'label is neither -1 nor 1: ' || cells[-1] END AS reason FROM cut)""",
        "good AS (SELECT * FROM judged WHERE reason IS NULL)",
        O.scored_sql("good", FIXED, ("batch_id",)),
        O.counts_sql(("batch_id",)),
    )
    + """ SELECT batch_id, 'counted' AS outcome, model, predicted, actual, n FROM counts
          UNION ALL SELECT batch_id, reason, NULL, NULL, NULL, count(*) FROM judged WHERE reason IS NOT NULL GROUP BY batch_id, reason"""
)
def query_stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spoilt lines in every batch: they are kept with the reason, and all others are counted."""
    run = open_run(spark, shared_folder(spark, "online"))
    stream = lambda lines: run_prequential(lines, FIXED, run, train=False, available_now=True, mode="permissive")
    feed_micro_batches(spark, sf_dir, stream, line=F.expr(_SPOILT_SQL))
    counts = read_counts(spark, run).withColumn("outcome", F.lit("counted"))
    rejects = read_rejects(spark, run).groupBy("batch_id", F.col("reject_reason").alias("outcome")).agg(F.count("*").alias("n"))
    return counts.unionByName(rejects, allowMissingColumns=True)


@_query(
    O.with_sql(
        O.STREAM_SQL,
        O.stream_batches_sql(BATCHES),
        "sizes AS (SELECT batch_id, count(*) AS n FROM batched GROUP BY batch_id)",
    )
    + f""" SELECT batch_id + CASE WHEN batch_id >= {EMPTY_BATCH} THEN 1 ELSE 0 END AS batch_id, n AS input_rows, n AS counted, 1 AS versions
           FROM sizes UNION ALL SELECT {EMPTY_BATCH}, 0, 0, 0"""
)
def query_stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval trigger over batches of which one is empty: rows that came in, rows counted, model versions left."""
    run, path = open_run(spark, shared_folder(spark, "online")), shared_folder(spark, "lines")
    lines, width, query = X.stream_lines(spark, sf_dir), X.batch_width(spark, sf_dir, BATCHES), None
    ranges = [F.col("event_id").between(b * width, (b + 1) * width - 1) for b in range(BATCHES)]
    ranges.insert(EMPTY_BATCH, F.lit(False))
    try:
        for ids in ranges:
            # One file, so that it arrives at once; an empty batch is an empty file.
            lines.where(ids).select("line").coalesce(1).write.mode("append").text(path)
            if query is None:
                query = run_prequential(
                    stream_text(spark, path, 1), [cold_model()], run, FIRST_STEP, interval="100 milliseconds", progress=True
                )
            query.processAllAvailable()
    finally:
        if query is not None:
            query.stop()
    drop_folder(spark, path)
    counted = read_counts(spark, run).groupBy("batch_id").agg(F.sum("n").alias("counted"))
    versions = spark.read.parquet(run.models).groupBy(F.col("version").cast("bigint").alias("batch_id")).agg(F.count("*").cast("int").alias("versions"))
    none = F.lit(0)
    return (
        read_progress(spark, run)
        .join(counted, "batch_id", "left")
        .join(versions, "batch_id", "left")
        .select("batch_id", "input_rows", F.coalesce("counted", none).alias("counted"), F.coalesce("versions", none).alias("versions"))
    )





@_query(
    O.with_sql(
        *_OFFLINE_FIT,
        O.STREAM_SQL,
        O.stream_batches_sql(BATCHES),
        O.points_sql("pts", "batched", "batch_id,"),
        f"s1 AS (SELECT model, w FROM offline UNION ALL SELECT '{COLD}', {O.ZEROS_SQL})",
        O.prequential_sql("online", "pts", "s1", ONLINE),
        f"""scored AS (SELECT b.batch_id, o.model, {O.predict_sql("o.w")} AS predicted, b.label AS actual
                       FROM batched AS b JOIN online AS o ON o.batch_id = b.batch_id)""",
        O.counts_sql(("batch_id",)),
        recursive=True,
    )
    + " SELECT * FROM counts"
)
def query_stream_prequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    warm, _ = train_offline(_items(spark, sf_dir), list(X.ITEM_KEYS))
    return _streamed_counts(spark, sf_dir, [warm, cold_model()], train=True)


# Reports.


def _report_table(spark: SparkSession, sf_dir: str) -> CountTable:
    """The counts of many batches with given commit times, all eras but the last closed."""
    width = X.batch_width(spark, sf_dir, REPORT_BATCHES)
    ends = X.with_batch(X.table(spark, sf_dir, "events"), width).groupBy("batch_id").agg(F.max("ts").cast("timestamp").alias("at"))
    table = CountTable(shared_folder(spark, "report-counts"), batches_per_era=6)
    table.write_batches(_batch_counts(spark, sf_dir, REPORT_BATCHES).join(ends, "batch_id"))
    table.close_before(spark, REPORT_BATCHES)
    return table


_REPORT = (
    O.STREAM_SQL,
    O.stream_batches_sql(REPORT_BATCHES),
    O.scored_sql("batched", FIXED, ("batch_id",)),
    O.counts_sql(("batch_id",)),
    O.running_sql(),
)


@_query(O.with_sql(*_REPORT) + " SELECT batch_id, model, round(accuracy, 6) AS accuracy FROM running")
def query_running_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Blocks shorter than the history, so that the check covers sums across blocks.
    series = running_accuracy(_batch_counts(spark, sf_dir, REPORT_BATCHES), block=7)
    return series.select("batch_id", "model", F.round("accuracy", 6).alias("accuracy"))


@_query(
    O.with_sql(
        *_REPORT,
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY batch_id DESC) AS r FROM running)",
    )
    + " SELECT CAST(1 - r AS INTEGER) AS seq, model, batch_id, round(accuracy, 6) AS accuracy FROM ranked WHERE r <= 20"
)
def query_last_n_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the newest eras alone: the batches before them enter as one total."""
    counts, before = _report_table(spark, sf_dir).newest(spark, POINTS)
    return last_points(running_accuracy(counts, block=7, before=before)).withColumn("accuracy", F.round("accuracy", 6))


@_query(
    O.with_sql(
        *_REPORT,
        "times AS (SELECT batch_id, max(ts) AS at FROM batched JOIN events USING (event_id) GROUP BY batch_id)",
        f"""ticks AS (SELECT tick, (SELECT date_trunc('day', min(ts)) FROM events) + tick * INTERVAL {TICK_HOURS} HOUR AS at
                      FROM range({TICKS}) AS r(tick))""",
        "points AS (SELECT * FROM running JOIN times USING (batch_id))",
    )
    + """ SELECT k.tick, m.model, arg_max(p.batch_id, p.at) AS batch_id, round(arg_max(p.accuracy, p.at), 6) AS accuracy
          FROM ticks AS k CROSS JOIN (SELECT DISTINCT model FROM running) AS m
          LEFT JOIN points AS p ON p.model = m.model AND p.at <= k.at GROUP BY k.tick, m.model"""
)
def query_accuracy_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running accuracy as it stood at fixed times; a batch is committed when its last event happens."""
    series = running_accuracy(_report_table(spark, sf_dir).read(spark), block=7)
    start = X.table(spark, sf_dir, "events").agg(F.date_trunc("day", F.min("ts").cast("timestamp"))).first()[0]
    grid = as_of(series, start, timedelta(hours=TICK_HOURS), TICKS, block=7)
    return grid.select("tick", "model", "batch_id", F.round("accuracy", 6).alias("accuracy"))
