"""Secret scan: single-pattern secrets, plus weak candidates confirmed by their other parts.

Three patterns report on their own (``assign``, ``access``, ``hex``). Three more match things
that are harmless alone: a 40-character key (``weak_secret``), an account or client id
(``weak_ident``) and a service address (``endpoint``). These are only reported when the parts
that make a usable credential stand within one scope of each other, found by an interval join
on (text, position bucket):

* ``weak_secret`` needs an identifier (``access`` or ``weak_ident``) in its scope,
* ``weak_ident`` needs a secret (``assign`` or ``weak_secret``),
* ``endpoint`` needs both.

All positions are code points, end exclusive. Everything is column expressions and joins.

Edge cases: a NULL text counts as empty and has no spans; repeated rows are all reported (links
are joined by the hash of the text, so copies share them); other columns pass through untouched, but
``find_secrets`` puts its results in the place of columns with their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prequenta.llm.common import table

# Fixed patterns of the base kinds.
BASE = {
    "assign": r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{24,}",  # the same spans as maximal runs of which short ones are dropped
}
MIN_ACCESS = 20
MIN_ASSIGNED = 6

WEAK = {
    "weak_secret": r"(?<![A-Za-z0-9+/])(?=[A-Za-z0-9+/]{0,39}[0-9])(?=[A-Za-z0-9+/]{0,39}[A-Z])[A-Za-z0-9+/]{40}(?![A-Za-z0-9+/])",
    "weak_ident": r"(?i:account|client|user|key)[_ ]?(?i:id)\x20*[:=]\x20*[A-Za-z0-9_.-]{4,}",
    "endpoint": r"(?i:https?|jdbc:[a-z0-9]{1,20}|amqps?|redis)://[A-Za-z0-9.:@_-]{4,}",
}
KINDS = [*BASE, *WEAK]
IDENTIFIERS = ("access", "weak_ident")
SECRETS = ("assign", "weak_secret")
SCOPE = 256

SPAN = "struct<start:int,kind:int,end:int>"


def _found(text: Column, kind: str) -> Column:
    """Matches of a kind with their gaps: all that is needed of the text to place the spans."""
    pattern = F.lit((BASE | WEAK)[kind])
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    if kind == "assign":
        keep = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda v: F.length(v) >= MIN_ASSIGNED)
    elif kind == "access":
        keep = F.transform(matches, lambda m: F.length(m) >= MIN_ACCESS)
    else:
        keep = F.transform(matches, lambda m: F.lit(True))
    sizes = F.transform(matches, F.length)
    gaps = F.transform(F.split(text, (BASE | WEAK)[kind]), F.length)
    return F.when(
        text.rlike((BASE | WEAK)[kind]),
        F.filter(
            F.arrays_zip(F.slice(gaps, 1, F.size(sizes)).alias("gap"), sizes.alias("size"), keep.alias("keep")),
            lambda x: x["size"].isNotNull(),
        ),
    )


def _spans(found: Column, kind: str) -> Column:
    """Spans of one kind in order, from gaps and sizes."""
    none = F.array().cast(f"array<{SPAN}>")
    number = F.lit(KINDS.index(kind))

    def step(acc, x):
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), number.alias("kind"), (start + x["size"]).alias("end"))
        return F.struct(
            (start + x["size"]).alias("at"),
            F.when(x["keep"], F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    placed = F.aggregate(found, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda acc: acc["spans"])
    return F.when(found.isNull(), none).otherwise(placed)


def _scanned(docs: DataFrame, text: str) -> DataFrame:
    """docs with ``_base`` and ``_weak`` spans, sorted by place; weak ones inside base spans are left out."""
    body = F.coalesce(F.col(text), F.lit(""))
    frame = docs.withColumns({f"_{kind}": _found(body, kind) for kind in KINDS})
    frame = frame.withColumns({f"_{kind}": _spans(F.col(f"_{kind}"), kind) for kind in KINDS})
    frame = frame.withColumn("_base", F.array_sort(F.concat(*[F.col(f"_{k}") for k in BASE])))
    weak = F.array_sort(F.concat(*[F.col(f"_{k}") for k in WEAK]))
    frame = frame.withColumn(
        "_weak",
        F.filter(weak, lambda w: ~F.exists(F.col("_base"), lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))),
    )
    return frame.drop(*[f"_{kind}" for kind in KINDS])


def _key(frame: DataFrame, text: str) -> Column:
    """Names the text of a row whose weak candidates may be confirmed; NULL for all other rows."""
    candidate = (F.size("_weak") > 0) & (F.size("_weak") + F.size("_base") > 1)
    return F.when(candidate, F.sha2(F.col(text), 256))


def links(docs: DataFrame, text: str = "text", scope: int = SCOPE) -> DataFrame:
    """(_key, linked spans) of the texts with confirmed weak candidates.

    An interval join: parts are dealt by text and position bucket, so a text with very many
    parts is spread over its buckets, each of which holds no more than fits in one scope.
    """
    number = {kind: KINDS.index(kind) for kind in KINDS}
    parts = (
        _scanned(docs.select(F.col(text).alias("_t")), "_t")
        .withColumn("_key", _key(docs, "_t"))
        .where("_key IS NOT NULL")
        .select("_key", "_base", "_weak")
        .dropDuplicates(["_key"])
        .select("_key", F.explode(F.concat("_base", "_weak")).alias("p"))
    )
    first, last = F.floor(F.col("p.start") / scope), F.floor(F.col("p.end") / scope)
    weak = parts.where(F.col("p.kind") >= number["weak_secret"]).select(
        "_key", F.col("p").alias("w"), F.explode(F.sequence(first - 1, last + 1)).alias("_at")
    )
    other = parts.where(F.col("p.kind").isin([number[k] for k in IDENTIFIERS + SECRETS])).select(
        "_key", F.col("p").alias("o"), F.explode(F.sequence(first, last)).alias("_at")
    )
    near = (F.col("o.start") - F.col("w.end") <= scope) & (F.col("w.start") - F.col("o.end") <= scope)
    pairs = weak.join(other, ["_key", "_at"]).where(near & (F.col("o") != F.col("w")))
    is_ident = F.col("o.kind").isin([number[k] for k in IDENTIFIERS])
    confirmed = pairs.groupBy("_key", "w").agg(F.max(is_ident).alias("ident"), F.max(~is_ident).alias("secret"))
    kind = F.col("w.kind")
    return (
        confirmed.where(
            ((kind == number["weak_secret"]) & F.col("ident"))
            | ((kind == number["weak_ident"]) & F.col("secret"))
            | ((kind == number["endpoint"]) & F.col("ident") & F.col("secret"))
        )
        .groupBy("_key")
        .agg(F.collect_list("w").alias("_linked"))
    )


def find_secrets(docs: DataFrame, text: str = "text", scope: int = SCOPE, spans: str = "spans", base: str = "base_spans") -> DataFrame:
    """docs with ``base`` and ``spans`` (base and linked): arrays of (start, kind, end) by place.

    ``kind`` is an index into ``KINDS``. Rows without a candidate never leave their partition. The
    results take the place of columns with their names.
    """
    docs = docs.drop(spans, base)
    frame = _scanned(docs, text).withColumn("_key", _key(docs, text))
    alone = frame.where("_key IS NULL").withColumn(spans, F.col("_base"))
    joined = (
        frame.where("_key IS NOT NULL")
        .join(links(docs, text, scope), "_key", "left")
        .withColumn(
            spans,
            F.array_sort(F.concat("_base", F.coalesce("_linked", F.array().cast(f"array<{SPAN}>")))),
        )
        .drop("_linked")
    )
    return alone.unionByName(joined).withColumnRenamed("_base", base).drop("_weak", "_key")


def redact(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """docs with every span of the text replaced by ``mask``; overlapping spans share one mask. Other columns stay as they are."""
    found = find_secrets(docs, text, scope, "_spans", "_base_spans")
    body = F.col(text)

    def step(acc, x):
        gap = F.substring(body, acc["at"] + 1, x["start"] - acc["at"])
        return (
            F.when(x["start"] >= acc["at"], F.struct(x["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mask)).alias("out")))
            .otherwise(F.struct(F.greatest(acc["at"], x["end"]).alias("at"), acc["out"].alias("out")))
        )

    masked = F.aggregate(
        F.col("_spans"),
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        step,
        lambda acc: F.concat(acc["out"], F.substring(body, acc["at"] + 1, F.length(body))),
    )
    return found.withColumn(text, F.when(F.size("_spans") > 0, masked).otherwise(body)).drop("_spans", "_base_spans")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["end"])), ","
    )


def _is(number: int):
    return lambda kind: kind == number


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs)
    kinds = F.transform("base_spans", lambda s: s["kind"])
    counts = [
        F.size(F.filter(kinds, _is(KINDS.index(kind)))).cast("long").alias(f"n_{kind}")
        for kind in BASE
    ]
    return found.select(
        "doc_id", *counts, F.sha2(_listed(F.col("base_spans")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans")
    )
