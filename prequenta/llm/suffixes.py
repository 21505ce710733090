"""Removal of repeated strings of at least ``LENGTH`` bytes, whole corpus, exact.

A string of LENGTH bytes is owned by its smallest ``GRAM``-byte gram (the rightmost of equal ones):
equal strings have equal owners at equal places, so only strings with the same owning gram need to be
compared. Successive strings of a document mostly share their owner; such a run is one row:
(gram, hash of the bytes the run spans, place), some 90 strings.

1. Runs meet by gram. Runs that span the same bytes are repeated as a whole; that settles copies
   however many there are, from hashes alone.
2. Where different runs share a gram, one of each kind is fetched from its text, and classes of its
   strings are refined by hashes, starting from (gram, place of the gram). Each step mixes the next
   eight bytes, from the end of the strings to their start, into the class and splits it by that; a
   class is given up when it holds a single string. Those left after all LENGTH bytes are the
   repeated strings. This takes the place of backward search: there is no Burrows-Wheeler
   transform, no rank or LF step and no suffix interval. Grams with very many kinds of runs are dealt out further by the bytes that
   all strings of a short stretch share, so no gram has to fit in one task.
3. The covered bytes go back to the documents as spans.

Strings are judged on the input. Matches never cross documents. Hashes are 64 bits within one gram
hash of 64 bits.

Edge cases: a NULL text counts as empty; texts shorter than LENGTH are left alone; a document that
is given twice repeats itself in full; rows with equal ids are told apart by their text; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prequenta.llm.common import table, written

LENGTH = 200
GRAM = 24
CHUNK = 1 << 18  # strings looked at together
HOT_KINDS = 2_000  # more kinds of runs under one gram are dealt out by stretches
STRETCH = 16
BUCKET_BYTES = 2_000_000
NO_ID = -(1 << 63)

_B = np.uint64(0x9E3779B97F4A7C15)


def _grams(data: np.ndarray) -> np.ndarray:
    """Hash of each GRAM-byte gram, by doubling."""
    with np.errstate(over="ignore"):
        level, power, width = data.astype(np.uint64) + np.uint64(1), _B, 1
        parts = {1: (level, power)}
        while width * 2 <= GRAM:
            level = level[:-width] * power + level[width:]
            power, width = power * power, width * 2
            parts[width] = (level, power)
        out, covered = None, 0
        for width in sorted(parts, reverse=True):
            if covered + width <= GRAM:
                level, power = parts[width]
                out = level if out is None else out[: len(data) - covered - width + 1] * power + level[covered:]
                covered += width
        out = out[: len(data) - GRAM + 1]
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(29))


def runs(data: bytes, length: int = LENGTH) -> Iterator[tuple[int, int, int, int]]:
    """(gram hash, place of the owning gram, first string, number of strings) in order."""
    n = len(data) - length + 1
    view = np.frombuffer(data, np.uint8)
    span = length - GRAM + 1  # grams in a string
    for start in range(0, n, CHUNK):
        upto = min(n, start + CHUNK)
        value = _grams(view[start : upto + length - 1])
        at = np.arange(len(value), dtype=np.int32)
        width = 1
        while width * 2 <= span:
            left, right = at[:-width], at[width:]
            at = np.where(value[right] <= value[left], right, left)
            width *= 2
        if width < span:
            left, right = at[: upto - start], at[span - width : span - width + upto - start]
            at = np.where(value[right] <= value[left], right, left)
        at = at[: upto - start]
        cut = np.concatenate([[0], np.flatnonzero(at[1:] != at[:-1]) + 1, [len(at)]])
        owner = at[cut[:-1]]
        yield from zip(
            value[owner].view(np.int64).tolist(), (owner + start).tolist(), (cut[:-1] + start).tolist(), np.diff(cut).tolist(), strict=True
        )


RUN = "gram long, kind long, id long, sum long, first int, n int, back int"


def _runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for i in range(batch.num_rows):
                data = (batch.column(1)[i].as_py() or "").encode("utf-8")
                if len(data) < length:
                    continue
                gram, place, first, n = zip(*runs(data, length), strict=True)
                kind = [digest(data[f : f + m - 1 + length], p - f) for p, f, m in zip(place, first, n, strict=True)]
                size = len(gram)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(gram, pa.int64()),
                        pa.array(np.array(kind, np.uint64).view(np.int64)),
                        pa.array([batch.column(0)[i].as_py()] * size, pa.int64()),
                        pa.array([batch.column(2)[i].as_py()] * size, pa.int64()),
                        pa.array(first, pa.int32()),
                        pa.array(n, pa.int32()),
                        pa.array(np.subtract(place, first), pa.int32()),
                    ],
                    ["gram", "kind", "id", "sum", "first", "n", "back"],
                )

    return run


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), body.alias("text"), F.crc32(body.cast("binary")).alias("sum"))


def candidates(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """Runs that are repeated as a whole (``copies`` > 1) or share their gram with other kinds (``kinds`` > 1)."""
    found = _keyed(docs, text).select("id", "text", "sum").mapInArrow(_runs(length), RUN)
    kind = Window.partitionBy("gram", "kind").orderBy("id", "sum", "first")
    whole = Window.partitionBy("gram", "kind").orderBy("id", "sum", "first").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    every = Window.partitionBy("gram").orderBy("kind").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return (
        found.repartition(F.col("gram"))
        .withColumns({"copies": F.count("*").over(whole), "nth": F.row_number().over(kind)})
        .withColumn("kinds", F.sum(F.when(F.col("nth") == 1, 1).otherwise(0)).over(every))
        .where("copies > 1 OR kinds > 1")
    )


def _cut(length: int):
    """Fetch the bytes of the runs of each text; runs under a hot gram as stretches with a group of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            for i in range(batch.num_rows):
                data = batch.column("text")[i].as_py().encode("utf-8")
                rows = []
                for r in batch.column("runs")[i].as_py():
                    first, n, back = r["first"], r["n"], r["back"]
                    if not r["hot"]:
                        rows.append((r["gram"], r["gram"], r["kind"], 0, n, back, data[first : first + n - 1 + length]))
                        continue
                    place = first + back
                    for stretch in range((back - n + 1) // STRETCH, back // STRETCH + 1):
                        # Strings that begin between STRETCH * stretch and STRETCH * stretch + STRETCH - 1 bytes before the gram.
                        lo = max(0, back - STRETCH * stretch - STRETCH + 1)
                        hi = min(n, back - STRETCH * stretch + 1)
                        start = place - STRETCH * stretch
                        core = data[start : start - STRETCH + 1 + length]
                        group = digest(core, seed=stretch) - (1 << 63)
                        rows.append((group, r["gram"], r["kind"], lo, hi - lo, back - lo, data[first + lo : first + hi - 1 + length]))
                columns = list(zip(*rows, strict=True)) or [()] * 7
                kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], STRINGS_NAMES)

    return run


STRINGS = "grp long, gram long, kind long, lo int, n int, back int, bytes binary"
STRINGS_NAMES = [c.split()[0] for c in STRINGS.split(", ")]


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _B + b
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _intervals(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(interval number of each suffix, whether it holds more than one)."""
    order = np.argsort(key)
    ranked = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.cumsum(new) - 1
    several = np.bincount(number)[number] > 1
    out, keep = np.empty(len(key), np.uint64), np.empty(len(key), bool)
    out[order], keep[order] = number, several
    return out, keep


def repeated(group: np.ndarray, n: np.ndarray, back: np.ndarray, strings: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(row, string within the row) of all strings that occur more than once within their group."""
    data = np.frombuffer(b"".join(strings) + bytes(8), np.uint8)
    word = np.zeros(len(data), np.uint64)
    for o in range(8):
        k = (len(data) - o) // 8
        word[o : o + 8 * k : 8] = np.frombuffer(data.tobytes()[o : o + 8 * k], "<u8")
    starts = np.cumsum([0, *map(len, strings)])[:-1]
    row = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[row] + nth
    interval, keep = _intervals(_mixed(group.view(np.uint64)[row], (back[row] - nth).astype(np.uint64)))
    for step in [*range(length - 8, 0, -8), 0]:
        row, nth, at, interval = row[keep], nth[keep], at[keep], interval[keep]
        if not len(row):
            break
        interval, keep = _intervals(_mixed(interval, word[at + step]))
    return row[keep], nth[keep]


SPANS = "gram long, kind long, lo int, hi int"


def _expand(length: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        column = {c: rows.column(c).to_numpy() for c in ("grp", "gram", "kind", "lo", "n", "back")}
        row, nth = repeated(column["grp"].astype(np.int64), column["n"].astype(np.int64), column["back"].astype(np.int64), rows.column("bytes").to_pylist(), length)
        opens = np.ones(len(row), bool)
        opens[1:] = (row[1:] != row[:-1]) | (nth[1:] != nth[:-1] + 1)
        closes = np.append(opens[1:], True) if len(row) else opens
        row, lo, hi = row[opens], nth[opens], nth[closes] + 1
        base = column["lo"][row]
        return pa.table(
            {
                "gram": pa.array(column["gram"][row], pa.int64()),
                "kind": pa.array(column["kind"][row], pa.int64()),
                "lo": pa.array((base + lo).astype(np.int32)),
                "hi": pa.array((base + hi).astype(np.int32)),
            }
        )

    return run


def repeated_spans(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """(id, sum, spans): per text with repeats, (first byte, end) of runs of repeated strings; they may overlap."""
    found = written(candidates(docs, length, text), "suffix-runs")
    one_each = found.where("kinds > 1 AND nth = 1")
    size = one_each.agg(F.sum(F.col("n") + length - 1)).first()[0] or 0
    per_text = one_each.groupBy("id", "sum").agg(
        F.collect_list(F.struct("gram", "kind", "first", "n", "back", (F.col("kinds") > HOT_KINDS).alias("hot"))).alias("runs")
    )
    strings = _keyed(docs, text).join(per_text, ["id", "sum"]).select("text", "runs").mapInArrow(_cut(length), STRINGS)
    n_buckets = max(1, size // BUCKET_BYTES)
    bucket = F.pmod(F.xxhash64("grp"), F.lit(n_buckets))
    spread = strings.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_expand(length), SPANS)
    partly = spread.groupBy("gram", "kind").agg(F.collect_list(F.struct("lo", "hi")).alias("parts"))
    whole = found.where("copies > 1").select("id", "sum", F.col("first").alias("s"), (F.col("first") + F.col("n") - 1 + length).alias("e"))
    parts = (
        found.where("copies = 1")
        .join(partly, ["gram", "kind"])
        .select("id", "sum", "first", F.explode("parts").alias("p"))
        .select("id", "sum", (F.col("first") + F.col("p.lo")).alias("s"), (F.col("first") + F.col("p.hi") - 1 + length).alias("e"))
    )
    return whole.unionByName(parts).groupBy("id", "sum").agg(F.collect_set(F.struct("s", "e")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            data = batch.column("text")[i].as_py().encode("utf-8")
            spans = merged([(x["s"], x["e"]) for x in batch.column("spans")[i].as_py() or []])
            at, kept = 0, hashlib.sha256()
            for s, e in spans:
                kept.update(data[at:s])
                at = e
            kept.update(data[at:])
            rows.append((len(data), sum(e - s for s, e in spans), len(spans), kept.hexdigest(), spans))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        listed = pa.array([[{"s": s, "e": e} for s, e in x] for x in columns[4]], pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(c, pa.int64()) for c in columns[:3]], pa.array(columns[3], pa.string()), listed],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
        )


def remove_repeats(docs: DataFrame, length: int = LENGTH, text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans): spans are the removed (first byte, end), merged."""
    spans = repeated_spans(docs, length, text)
    keyed = _keyed(docs, text).withColumn("doc_id", F.when(F.col("id") != NO_ID, F.col("id")))
    joined = keyed.join(spans, ["id", "sum"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(
        _kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<s:int,e:int>>"
    )


def op4_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("spans")
