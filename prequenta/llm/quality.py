"""Quality rules: plain limits, and documents that lie apart from the others of their language and source.

Per text a vector of transformed statistics (``STATISTICS``) is put on a lattice of 1/256, so that
all sums below are whole numbers and the same under any partitioning. Per language and source the
minimum-covariance-determinant estimate is fitted: the mean and covariance of those ``SHARE`` of
the rows that give the smallest determinant. It starts from medians, once with the spread of the
medians' absolute deviations and once with the resolutions alone, and repeats concentration steps
over all rows until the means rest: distances of all rows, the distance that ``SHARE`` of them do
not exceed, sums over these rows. The distance is found from counts of narrow bins, of which the
last is weighted so that the share is met exactly. The start with the smaller determinant stays.

The covariance is made consistent for normal data, and each statistic's ``resolution`` is added to
its spread: where nearly all texts agree (no symbols at all), a covariance alone would reject every
other text. A document is rejected if its squared Mahalanobis distance is above the chi-square
quantile of ``REJECTED``.

Groups of fewer than ``MIN_ROWS`` rows form one group together; if that is smaller too, only the
plain limits hold for it. Rows of a group are only ever summed, so a hot source is no long task;
the estimates are a table of one small row per group.

Edge cases: NULL texts have no words; NULL in lang or source is a value of its own; repeated rows
count as often as they occur and get a row each; ids may be NULL; an empty table gives no rows.
Other columns are ignored unless named in ``keep``, where a column with the name of a result gives
way to it.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from math import exp, factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prequenta.llm.common import drop_written, table, written

# Fixed values of the plain limits.
MIN_WORDS = 50
BLANKS = " \t\n\r\x0b\x0c"
SYMBOLS = "#*$%&|<>"

#: Statistic: its resolution, the spread that texts of a group may have beside the fitted one.
STATISTICS = {
    "log of words": 1.0,
    "log of code points in a word": 0.15,
    "log of symbols per 100 code points": 0.25,
    "log of repeated lines in 10": 0.5,
    "log of repeated words in 10": 0.5,
    "log of upper case letters per 10 code points": 0.25,
}
P = len(STATISTICS)
LATTICE = 256
RESOLUTION = np.array(list(STATISTICS.values())) * LATTICE
SHARE = 0.75
REJECTED = 1e-5
MIN_ROWS = 60
STEPS = 12
AT_REST = 0.01  # of a resolution
BINS = 16  # per factor of two of a squared distance
NOT_UPPER = bytes(b for b in range(256) if not 65 <= b <= 90)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RESULTS = (*COUNTS, "base_failed", "kept", "distance")


def chi_square(x: float, freedom: int) -> float:
    """Distribution function for an even number of degrees of freedom."""
    return 1 - exp(-x / 2) * sum((x / 2) ** i / factorial(i) for i in range(freedom // 2))


def chi_square_quantile(p: float, freedom: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi_square(middle, freedom) < p else (low, middle)
    return low


CUTOFF = chi_square_quantile(1 - REJECTED, P)
CONSISTENT = SHARE / chi_square(chi_square_quantile(SHARE, P), P + 2)


def repeated_words(words: list) -> int:
    """Words that lie in a window of three words that the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times = Counter(windows)
    covered = bytearray(len(words))
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered[at : at + 3] = b"\1\1\1"
    return sum(covered)


def counts_of(text: str) -> tuple[int, ...]:
    """The ``COUNTS``, then the lines that hold a word, and the upper case letters A-Z."""
    data = text.encode(errors="surrogatepass")
    words = data.split()  # bytes are split at blanks, tabs and line ends only
    chars = len(text) - sum(map(text.count, BLANKS))
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    upper = len(data.translate(None, NOT_UPPER))
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words), len(lines), upper


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its counts and its place on the lattice."""
    for batch in batches:
        for start in range(0, batch.num_rows, 512):
            piece = batch.slice(start, 512)
            counts = np.array([counts_of(t or "") for t in piece.column(0).to_pylist()], np.int64).reshape(-1, 7)
            words, chars, symbols, repeated, again, lines, upper = counts.T.astype(float)
            some = np.maximum(chars, 1)
            places = [
                np.log1p(words),
                np.log(some / np.maximum(words, 1)),
                np.log1p(100 * symbols / some),
                np.log1p(10 * repeated / np.maximum(lines, 1)),
                np.log1p(10 * again / np.maximum(words, 1)),
                np.log1p(10 * upper / some),
            ]
            whole = [pa.array(np.rint(p * LATTICE).astype(np.int64)) for p in places]
            failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > 50 * counts[:, 0])
            arrays = [*piece.columns[1:], *[pa.array(c) for c in counts.T[:5]], pa.array(failed), *whole]
            yield pa.RecordBatch.from_arrays(arrays, [*piece.schema.names[1:], *COUNTS, "base_failed", *[f"t{i}" for i in range(P)]])


def measured(docs: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """(row, cell, counts..., base_failed, t0..): one row per document; ``row`` has the columns to keep."""
    cell = F.to_json(F.struct(F.col("lang").cast("string").alias("l"), F.col("source").cast("string").alias("s")))
    kept = [F.col(c) for c in keep if c not in RESULTS]
    source = docs.select(F.col("text"), F.struct(*kept, F.lit(0).alias("_")).alias("row"), cell.alias("cell"))
    kind = source.schema["row"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    return source.mapInArrow(_measured, f"row {kind}, cell string, {counts}, base_failed boolean, " + ", ".join(f"t{i} long" for i in range(P)))


def _shape(mean: np.ndarray, spread: np.ndarray) -> dict:
    """What the distance needs: means, coefficients of the products of two deviations, and the log determinant."""
    inverse = np.linalg.inv(spread)
    return {
        "mean": mean.tolist(),
        "form": [float(inverse[i, j]) * (1 if i == j else 2) for i, j in PAIRS],
        "size": float(np.linalg.slogdet(spread)[1]),
    }


FIT = "grp string, start int, n long, mean array<double>, form array<double>, size double"
DISTANCE = " + ".join(f"get(form, {k}) * (t{i} - get(mean, {i})) * (t{j} - get(mean, {j}))" for k, (i, j) in enumerate(PAIRS))


def _starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = _arrow(FIT)
    for batch in batches:
        for row in batch.to_pylist():
            middle, away = np.array(row["middle"], float), np.array(row["away"], float) * 1.4826
            fits = [_shape(middle, np.diag(away**2 + RESOLUTION**2)), _shape(middle, np.diag(RESOLUTION**2))]
            yield pa.RecordBatch.from_pylist([{"grp": row["grp"], "start": s, "n": row["n"]} | f for s, f in enumerate(fits)], schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split(" ") for part in ddl.split(", "))])


def _concentrated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Mean and covariance from whole sums inside the distance and in the bin at it, which has a weight."""
    schema = _arrow(FIT)
    for batch in batches:
        fits = []
        for row in batch.to_pylist():
            sums = np.zeros(1 + P + len(PAIRS))
            for part in row["parts"]:
                weight = row["weight"] if part["at"] else 1.0
                sums += weight * np.array([int(v) for v in part["sums"]], float)
            first = sums[1 : P + 1] / sums[0]
            spread = np.zeros((P, P))
            for (i, j), total in zip(PAIRS, sums[P + 1 :], strict=True):
                spread[i, j] = spread[j, i] = total / sums[0] - first[i] * first[j]
            shape = _shape(np.rint(row["mean"]) + first, CONSISTENT * spread + np.diag(RESOLUTION**2))
            fits.append({"grp": row["grp"], "start": row["start"], "n": row["n"]} | shape)
        yield pa.RecordBatch.from_pylist(fits, schema)


def _middles(rows: DataFrame) -> DataFrame:
    """Medians and the medians of the absolute deviations; places are on a lattice, so buffers are bounded."""
    halves = [F.percentile(f"t{i}", F.lit(0.5)) for i in range(P)]
    middle = rows.groupBy("grp").agg(F.count("*").alias("n"), F.array(*halves).alias("middle"))
    middle = written(middle, "quality-medians")
    away = [F.percentile(F.abs(F.col(f"t{i}") - F.get("middle", F.lit(i))), F.lit(0.5)) for i in range(P)]
    return rows.join(middle, "grp").groupBy("grp", "n", "middle").agg(F.array(*away).alias("away"))


def _step(rows: DataFrame, fits: DataFrame) -> DataFrame:
    """One concentration step of every group and start over all rows."""
    near = rows.join(fits, "grp").withColumn("d", F.expr(DISTANCE))
    bin_of = F.floor(F.log2(F.greatest(F.col("d"), F.lit(2.0**-20))) * BINS).cast("int")
    near = near.withColumn("bin", F.coalesce(bin_of, F.lit(2**30)))
    upto = Window.partitionBy("grp", "start").orderBy("bin")
    most = F.ceil(F.col("n") * F.lit(SHARE))
    cuts = (
        near.groupBy("grp", "start", "n", "bin")
        .agg(F.count("*").alias("here"))
        .withColumn("upto", F.sum("here").over(upto))
        .where((F.col("upto") >= most) & (F.col("upto") - F.col("here") < most))
        .select("grp", "start", F.col("bin").alias("cut"), ((most - F.col("upto") + F.col("here")) / F.col("here")).alias("weight"))
    )
    # Deviations from the rounded mean are whole numbers, and so are the sums of their products.
    y = [F.col(f"t{i}") - F.rint(F.get("mean", F.lit(i))).cast("long") for i in range(P)]
    sums = [F.count("*"), *[F.sum(v) for v in y], *[F.sum(y[i] * y[j]) for i, j in PAIRS]]
    parts = (
        near.join(cuts, ["grp", "start"])
        .where("bin <= cut")
        .groupBy("grp", "start", (F.col("bin") == F.col("cut")).alias("at"), "weight")
        .agg(F.array(*sums).alias("sums"))
    )
    gathered = parts.groupBy("grp", "start", "weight").agg(F.collect_list(F.struct("at", "sums")).alias("parts"))  # two at most
    return gathered.join(fits.select("grp", "start", "n", "mean"), ["grp", "start"]).mapInArrow(_concentrated, FIT)


def fitted(rows: DataFrame) -> DataFrame:
    """The estimate of every group (``FIT``); ``rows`` has the group in ``grp`` and the places t0.. ."""
    fits = written(_middles(rows).mapInArrow(_starts, FIT), "quality-fits")
    for _ in range(STEPS):
        before, fits = fits, written(_step(rows, fits), "quality-fits")
        then = before.select("grp", "start", F.col("mean").alias("then"))
        moved = [F.max(F.abs(F.get("mean", F.lit(i)) - F.get("then", F.lit(i))) / r) for i, r in enumerate(RESOLUTION.tolist())]
        most = fits.join(then, ["grp", "start"]).agg(F.greatest(*moved)).first()[0]
        drop_written(before)
        if most is None or most <= AT_REST:
            break
    return written(fits.groupBy("grp").agg(F.min_by(F.struct("mean", "form"), F.struct("size", "start")).alias("fit")).select("grp", "fit.*"), "quality-fits")


def assess(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep..., counts..., base_failed, kept, distance), one row per document."""
    rows = written(measured(docs, keep), "quality-rows")
    sizes = rows.groupBy("cell").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") >= MIN_ROWS, F.col("cell")).otherwise(F.lit("small groups"))
    groups = sizes.select("cell", own.alias("grp"), "n")
    enough = groups.groupBy("grp").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_ROWS)
    groups = written(groups.select("cell", "grp").join(enough.select("grp"), "grp", "left_semi"), "quality-groups")
    fits = fitted(rows.join(groups, "cell"))
    judged = rows.join(groups.join(fits, "grp"), "cell", "left").withColumn("distance", F.expr(DISTANCE))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    names = [c for c in keep if c not in RESULTS]
    return judged.select(*[F.col("row")[c].alias(c) for c in names], *COUNTS, "base_failed", kept.alias("kept"), "distance")


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_failed, kept and distance of every document."""
    return assess(table(spark, sf_dir, "documents"))
