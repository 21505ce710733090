"""From text lines to labelled points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prequenta.functions import cells as C
from prequenta.model import N_FEATURES

REJECT = "reject_reason"


def _integer_rows(df: DataFrame, line: str, keep: tuple[str, ...]) -> DataFrame:
    text = df.select(*keep, F.col(line).alias("_line"), C.split_cells(F.col(line)).alias("_text"))
    return text.select(*keep, "_line", F.size("_text").alias("_width"), C.int_cells(F.col("_text")).alias("_cells"))


def _is_header(line: Column, header: str) -> Column:
    # Null-safe: a NULL line is no header, so it stays for the parser to judge.
    return F.split_part(line, F.lit(C.DELIMITER), F.lit(1)).eqNullSafe(header.split(C.DELIMITER)[0])


def drop_header(df: DataFrame, header: str, line: str = "value") -> DataFrame:
    """Keep the lines whose first cell differs from the header's first cell.

    Works for any number of files, each with its own header line.
    """
    return df.where(~_is_header(df[line], header))


def parse_labelled(
    df: DataFrame,
    line: str = "value",
    n_features: int = N_FEATURES,
    mode: str = "strict",
    keep: tuple[str, ...] = (),
    header: str | None = None,
) -> DataFrame:
    """Parse lines to ``(keep..., label int, features array<double>)``.

    ``strict`` fails the query on the first line that has the wrong width, a cell that is
    no integer, or a label other than -1 and 1. ``permissive`` keeps every line and adds
    ``line`` and ``reject_reason``, which is NULL for good lines; see ``split_rejects``.
    Neither mode depends on the session's ANSI setting. With ``header``, lines that begin
    with its first cell are dropped, as ``drop_header`` does.
    """
    if mode not in ("strict", "permissive"):
        raise ValueError(f"unknown mode {mode!r}")
    is_header = F.lit(False)
    if header is not None:
        df = drop_header(df, header, line)
        # A filter on parsed columns can be merged with the one above, and what it uses more
        # than once is evaluated before both. So a header must not fail the parser either.
        is_header = _is_header(F.col("_line"), header)
    ints = _integer_rows(df, line, keep).withColumn("_header", is_header)
    raw_label = F.get("_cells", F.lit(n_features))
    reason = (
        F.when(F.col("_header"), F.lit(None).cast("string"))
        .when(F.col("_line").isNull(), F.lit("no line"))
        .when(F.col("_width") != n_features + 1, F.concat(F.lit("cells in line: "), F.col("_width").cast("string")))
        .when(F.expr(C.any_missing("_cells")), F.lit("a cell is no integer"))
        .otherwise(C.label_fault(raw_label))
    )
    checked = ints.select(*keep, "_line", "_cells", C.label_class(raw_label).alias("_label"), reason.alias("_reason"))
    features = f"CAST(slice(_cells, 1, {n_features}) AS ARRAY<DOUBLE>)"
    if mode == "strict":
        failure = "raise_error(concat(_reason, ' in line: ', coalesce(_line, 'NULL')))"
        # Both columns carry the check, so that pruning one cannot drop it.
        return checked.selectExpr(
            *keep,
            f"CASE WHEN _reason IS NULL THEN _label ELSE CAST({failure} AS INT) END AS label",
            f"CASE WHEN _reason IS NULL THEN {features} ELSE CAST({failure} AS ARRAY<DOUBLE>) END AS features",
        )
    return checked.selectExpr(
        *keep,
        "_line AS line",
        "CASE WHEN _reason IS NULL THEN _label END AS label",
        f"CASE WHEN _reason IS NULL THEN {features} END AS features",
        f"_reason AS {REJECT}",
    )


def split_rejects(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows and rejected lines of a permissive parse; both read the same input."""
    good = parsed.where(F.col(REJECT).isNull()).drop("line", REJECT)
    bad = parsed.where(F.col(REJECT).isNotNull()).drop("label", "features")
    return good, bad


def named_rows(
    df: DataFrame, header: str | list[str], line: str = "value", keep: tuple[str, ...] = ()
) -> DataFrame:
    """One bigint column per header name; a line with a bad cell or width fails the query."""
    names = header.split(C.DELIMITER) if isinstance(header, str) else header
    checked = _integer_rows(df, line, keep).selectExpr(
        *keep,
        "_cells",
        f"CASE WHEN _width = {len(names)} AND NOT {C.any_missing('_cells')} THEN true"
        " ELSE CAST(raise_error(concat('not a row of integers: ', coalesce(_line, 'NULL'))) AS BOOLEAN) END AS _ok",
    )
    # Each column carries the check, so that pruning the others cannot drop it.
    return checked.select(*keep, *[F.expr(f"IF(_ok, get(_cells, {i}), NULL)").alias(n) for i, n in enumerate(names)])


def publish_payload(df: DataFrame, line: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """The message body per line: blanks stripped from both ends, UTF-8 bytes in ``value``."""
    return df.select(*keep, F.encode(C.strip_line(df[line]), "UTF-8").alias("value"))
