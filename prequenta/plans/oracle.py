"""SQL for the checked queries, written for the same tables and run by another engine."""

from __future__ import annotations

from prequenta.functions.hashing import MODULUS, MULTIPLIERS, share_limit
from prequenta.model import COLD, KEY_SUFFIX, N_FEATURES, PRETRAINED, SERIES_LABEL, Model
from prequenta.operators.fit import SgdSettings
from prequenta.operators.split import SEED, poisson_limits
from prequenta.plans.fixtures import ITEM_KEYS, ITEMS_SQL, LINE_SQL, STREAM_SQL, VECTORS_SQL, batch_sql


def list_sql(values) -> str:
    return "[" + ", ".join(repr(float(v)) for v in values) + "]::DOUBLE[]"


ZEROS_SQL = list_sql([0.0] * N_FEATURES)


def with_sql(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts)


def predict_sql(weights: str) -> str:
    return f"CASE WHEN 1 / (1 + exp(-list_dot_product(CAST(f AS DOUBLE[]), {weights}))) > 0.5 THEN 1 ELSE 0 END"


def bucket_sql(keys: tuple[str, ...], seed: int = SEED) -> str:
    def folded(multiplier: int) -> str:
        state = f"CAST({seed % MODULUS} AS BIGINT)"
        for key in keys:
            residue = f"((CAST({key} AS BIGINT) % {MODULUS}) + {MODULUS}) % {MODULUS}"
            state = f"(({state} + {residue}) % {MODULUS}) * {multiplier} % {MODULUS}"
        return state

    high, low = map(folded, MULTIPLIERS)
    return f"({high}) * {MODULUS} + ({low})"


def states_sql(keys: tuple[str, ...], seed: int = SEED) -> tuple[str, str]:
    high, low = bucket_sql(keys, seed).rsplit(f" * {MODULUS} + ", 1)
    return high, low


def scattered_sql(name: str, source: str, keys: tuple[str, ...], seed: int = SEED) -> str:
    """``<name>``: the rows of ``source`` with the scattered ``bucket`` of their keys."""
    high, low = states_sql(keys, seed)
    inner = f"SELECT *, {high} AS h0, {low} AS l0 FROM {source}"
    for r in range(2):
        inner = f"SELECT *, (h{r} + l{r} * l{r} % {MODULUS}) % {MODULUS} AS h{r + 1} FROM ({inner})"
        inner = f"SELECT *, (l{r} + h{r + 1} * h{r + 1} % {MODULUS}) % {MODULUS} AS l{r + 1} FROM ({inner})"
    return f"{name} AS (SELECT *, h2 * {MODULUS} + l2 AS bucket FROM ({inner}))"


def draws_sql(mean: float) -> str:
    return " + ".join(f"CASE WHEN bucket >= {limit} THEN 1 ELSE 0 END" for limit in poisson_limits(mean))


def in_train_sql(keys: tuple[str, ...], fraction: float) -> str:
    return f"{bucket_sql(keys)} < {share_limit(fraction)}"


def scored_sql(source: str, models: tuple[Model, ...], keep: tuple[str, ...]) -> str:
    """``scored``: one row per input row and model."""
    parts = [
        f"SELECT {', '.join([*keep, ''])} '{m.name}' AS model, {predict_sql(list_sql(m.weights))} AS predicted,"
        f" label AS actual FROM {source}"
        for m in models
    ]
    return "scored AS (" + " UNION ALL ".join(parts) + ")"


def counts_sql(by: tuple[str, ...] = ()) -> str:
    columns = ", ".join([*by, "model", "predicted", "actual"])
    return f"counts AS (SELECT {columns}, count(*) AS n FROM scored GROUP BY {columns})"


def _gradient_step(state: str, points: str, join: str, keys: str, settings: SgdSettings, width: int = N_FEATURES) -> str:
    """One descent step for every row of ``state``; yields ``keys``, ``i``, ``w``, ``v`` (new weights)."""
    scale = f"({settings.step!r} / sqrt(any_value(i) + 1))"
    new = ", ".join(
        f"any_value(w)[{k}] * (1 - {scale} * {settings.reg_param!r}) - {scale} * avg(e * x[{k}])"
        for k in range(1, width + 1)
    )
    return f"""SELECT {keys}, any_value(i) AS i, any_value(w) AS w, [{new}] AS v
        FROM (SELECT {state}.*, p.x, 1 / (1 + exp(-list_dot_product(p.x, {state}.w))) - p.y AS e
              FROM {state} JOIN {points} AS p ON {join}) GROUP BY {keys}"""


def _moved_little(settings: SgdSettings) -> str:
    distance = "sqrt(list_sum(list_transform(range(1, len(v) + 1), lambda k: (v[k] - w[k]) * (v[k] - w[k]))))"
    norm = "sqrt(list_dot_product(v, v))"
    return f"(i >= 1 AND {distance} < {settings.tol!r} * greatest({norm}, 1))"


def fit_sql(name: str, points: str, start: str, settings: SgdSettings, width: int = N_FEATURES) -> str:
    """``<name>(model, w)``: gradient descent over ``points(x, y)`` from ``start(model, w)``."""
    unfinished = f"NOT {name}_steps.done AND {name}_steps.i < {settings.iterations}"
    step = _gradient_step(f"{name}_steps", points, unfinished, "model", settings, width)
    return f"""
    {name}_steps(model, i, w, done) AS (
        SELECT model, 0, w, false FROM {start}
        UNION ALL
        SELECT model, i + 1, v, {_moved_little(settings)} FROM (
            {step})),
    {name} AS (SELECT model, arg_max(w, i) AS w FROM {name}_steps GROUP BY model)"""


def prequential_sql(name: str, points: str, start: str, settings: SgdSettings) -> str:
    """``<name>(model, batch_id, w)``: the weights each batch of ``points(batch_id, x, y)`` meets."""
    step = _gradient_step(
        f"{name}_steps", points, f"p.batch_id = {name}_steps.batch_id", "model, batch_id", settings
    )
    last = f"({_moved_little(settings)} OR i + 1 = {settings.iterations})"
    return f"""
    {name}_steps(model, batch_id, i, w) AS (
        SELECT model, CAST(0 AS BIGINT), 0, w FROM {start}
        UNION ALL
        SELECT model, CASE WHEN {last} THEN batch_id + 1 ELSE batch_id END, CASE WHEN {last} THEN 0 ELSE i + 1 END, v
        FROM ({step})),
    {name} AS (SELECT model, batch_id, w FROM {name}_steps WHERE i = 0)"""


def optimum_sql(name: str, points: str, reg_param: float, step: float = 5.0, momentum: float = 0.8, iterations: int = 160) -> str:
    """``<name>(w)``: the optimum of the mean loss with an absolute penalty on the standardised weights.

    Descent with momentum: from ``a``, a step ahead of the weights ``w``, and each step followed by the
    shrinking step of the penalty. ``<name>_listed`` has a row per weight, with the gradient there and
    the bound of the penalty's sub-gradient.
    """

    def new(k: int) -> str:
        moved = f"(any_value(a)[{k}] - {step!r} * avg(e * x[{k}]))"
        return f"sign({moved}) * greatest(abs({moved}) - {step * reg_param!r} * any_value(s)[{k}], 0)"

    ks = range(1, N_FEATURES + 1)
    return f"""
    {name}_spread AS MATERIALIZED (SELECT [{", ".join(f"stddev_samp(x[{k}])" for k in ks)}] AS s FROM {points}),
    {name}_steps(i, w, a) AS (
        SELECT 0, {ZEROS_SQL}, {ZEROS_SQL}
        UNION ALL
        SELECT i + 1, v, [{", ".join(f"v[{k}] + {momentum!r} * (v[{k}] - w[{k}])" for k in ks)}] FROM (
            SELECT i, any_value(w) AS w, [{", ".join(new(k) for k in ks)}] AS v FROM (
                SELECT t.i, t.w, t.a, p.x, z.s, 1 / (1 + exp(-list_dot_product(p.x, t.a))) - p.y AS e
                FROM {name}_steps AS t JOIN {points} AS p ON t.i < {iterations} JOIN {name}_spread AS z ON true) GROUP BY i)),
    {name} AS (SELECT arg_max(w, i) AS w FROM {name}_steps),
    {name}_slope AS (SELECT [{", ".join(f"avg(e * x[{k}])" for k in range(1, N_FEATURES + 1))}] AS g FROM (
        SELECT p.x, 1 / (1 + exp(-list_dot_product(p.x, b.w))) - p.y AS e FROM {points} AS p JOIN {name} AS b ON true)),
    {name}_listed AS (SELECT k, w[k] AS weight, g[k] AS slope, {reg_param!r} * s[k] AS bound
                      FROM {name}, {name}_slope, {name}_spread, range(1, {N_FEATURES + 1}) AS r(k))"""


def points_sql(name: str, source: str, columns: str = "", where: str = "true", constant: bool = False) -> str:
    x = "CAST(f AS DOUBLE[])" + (" || [1]::DOUBLE[]" if constant else "")
    return f"{name} AS MATERIALIZED (SELECT {columns} {x} AS x, label AS y FROM {source} WHERE {where})"


def start_sql(name: str, models: dict[str, str]) -> str:
    return f"{name} AS (" + " UNION ALL ".join(f"SELECT '{m}' AS model, {w} AS w" for m, w in models.items()) + ")"


def weights_out_sql(source: str, width: int = N_FEATURES) -> str:
    return (
        f"SELECT model, unnest(range(1, {width + 1})) AS k, round(unnest(w), 6) AS weight FROM {source}"
    )


CELLS_SQL = "array_to_string(f, ' ')"
ITEM_KEY_SQL = ", ".join(ITEM_KEYS)
HIT_SQL = "sum(CASE WHEN predicted = actual THEN n ELSE 0 END)"


def accuracy_sql() -> str:
    names = " ".join(f"WHEN '{m}' THEN '{text}'" for m, text in SERIES_LABEL.items())
    return f"""SELECT CASE model {names} END AS type,
        round(CAST({HIT_SQL} AS DOUBLE) / CAST(sum(n) AS DOUBLE), 6) AS value FROM counts GROUP BY model"""


def running_sql() -> str:
    return f"""running AS (
        SELECT batch_id, model,
               CAST(sum(hit) OVER w AS DOUBLE) / CAST(sum(total) OVER w AS DOUBLE) AS accuracy
        FROM (SELECT model, batch_id, {HIT_SQL} AS hit, sum(n) AS total FROM counts GROUP BY model, batch_id)
        WINDOW w AS (PARTITION BY model ORDER BY batch_id))"""


def stream_batches_sql(batches: int) -> str:
    return f"batched AS (SELECT *, {batch_sql(batches)} AS batch_id FROM stream)"


def counter_key_sql() -> str:
    suffix = " ".join(f"WHEN '{m}' THEN '{text}'" for m, text in KEY_SUFFIX.items())
    return f"predicted || ':' || CAST(CAST(actual AS DOUBLE) AS VARCHAR) || CASE model {suffix} END"
