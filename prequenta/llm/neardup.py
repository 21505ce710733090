"""Near duplicates by Order MinHash, verified by banded alignment.

A text is the sequence of its shingles (``SHINGLE`` words each), every shingle labelled with its
occurrence number, so that all are different. Order MinHash takes, under each of ``BANDS`` hash
functions, the ``SAMPLE`` smallest labelled shingles and keeps them in text order: two texts agree
in a band if they share these shingles in the same order, which the edit distance governs.

Texts that agree in a band are candidates, verified by alignment. Shingles are only aligned within
the band of diagonals that the threshold allows; the similarity is aligned / (n1 + n2 - aligned)
and must reach ``THRESHOLD``. Classes are the connected components of the verified links.

Two steps find the links. First the texts of a bucket of a band are aligned with its hub, the text
that shares most places with others, which joins most copies at a cost linear in the bucket. Then
all texts of a bucket that are still in different classes are compared, block against block, by a
parity sketch of their shingles: differing bits never outnumber differing shingles, so a pair that
the sketch rejects cannot reach the threshold, and only the few others become rows and are aligned.
Every candidate is thus aligned, proven too different, or in one class already: no link is lost.

Equal texts (same words, any case and spacing) are one node throughout. With 32 bands a pair at the
threshold is missed with a chance of about 3e-6, one at 0.85 with 1e-8.

Edge cases: NULL counts as empty and empty texts are copies of each other; texts of fewer words
than a shingle are one shingle; a row without an id has no class and is not compared; repeated rows
share a class; an empty table gives an empty result; other columns are ignored (and pass through
``deduplicated``).
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prequenta.llm.common import drop_written, make_room, small_batches, table, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 32
SAMPLE = 5
SHORT = 12  # texts of fewer shingles are sampled less at a time ...
SHORT_SAMPLE = 3
SHORT_BANDS = 24
SHORT_UPTO = 15  # ... and so are those that may be similar to them
MEMO_WORDS = 200_000
SLICE = 128  # texts that are split into words at a time
PARITY_BITS = 2048
BLOCKS_AT_ONCE = 64  # pairs of blocks that travel to Python together, of some 150 kB each
BLOCK = 256  # texts of a bucket that are compared with as many others at a time

_R = np.random.default_rng(20)
_MULTIPLY = _R.integers(1, 2**63, BANDS + SHORT_BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _R.integers(0, 2**63, BANDS + SHORT_BANDS, dtype=np.uint64)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[str], memo: Words, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the occurrence-labelled shingles, in text order; all different."""
    code = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    size = min(size, len(code))
    if not size:
        return code
    n = len(code) - size + 1
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * _C2 + code[i : i + n]
    out = _mix(out)
    order = np.argsort(out, kind="stable")
    ranked = out[order]
    first = np.ones(n, bool)
    first[1:] = ranked[1:] != ranked[:-1]
    if not first.all():
        start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
        label = np.empty(n, np.uint64)
        label[order] = (np.arange(n) - start).astype(np.uint64)
        out = np.where(label > 0, _mix(out + label * _C1), out)
    return out


def signatures(labelled: np.ndarray) -> np.ndarray:
    """Order MinHash of each band, as one hash that also names the band."""
    n = len(labelled)
    out = []
    if n >= SHORT:
        step = max(1, min(BANDS, (1 << 20) // n))
        for t in range(0, BANDS, step):
            value = labelled[None, :] * _MULTIPLY[t : t + step, None] + _ADD[t : t + step, None]
            at = np.sort(np.argpartition(value, SAMPLE - 1, axis=1)[:, :SAMPLE], axis=1)
            out.append(_ordered(labelled[at], np.arange(t, t + len(at))))
    if SHORT_SAMPLE < n <= SHORT_UPTO:  # with fewer shingles only equal texts are similar enough
        value = labelled[None, :] * _MULTIPLY[BANDS:, None] + _ADD[BANDS:, None]
        at = np.sort(np.argpartition(value, SHORT_SAMPLE - 1, axis=1)[:, :SHORT_SAMPLE], axis=1)
        out.append(_ordered(labelled[at], np.arange(BANDS, BANDS + SHORT_BANDS)))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def parity(labelled: np.ndarray) -> bytes:
    """Number of shingles, then for each of ``PARITY_BITS`` bins whether it holds an odd number of them."""
    bins = np.bincount((labelled % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
    return np.int64(len(labelled)).tobytes() + np.packbits(bins.astype(np.uint8)).tobytes()


def needed_of(n: np.ndarray | int, threshold: float) -> np.ndarray:
    """Aligned shingles that two texts of n together must have."""
    return np.ceil(threshold * n / (1 + threshold) - 1e-9).astype(np.int64)


def _ordered(picked: np.ndarray, band: np.ndarray) -> np.ndarray:
    value = band.astype(np.uint64) * _C1
    for column in picked.T:
        value = _mix(value * _C2 + column)
    return value


def aligned(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> tuple[bool, int]:
    """(similar, insertions and deletions of the best alignment); within the band first, in full if that fails."""
    n = len(a) + len(b)
    needed = int(needed_of(np.float64(n), threshold))
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    differ = np.flatnonzero(a[::-1][: short - head] != b[::-1][: short - head])
    tail = int(differ[0]) if len(differ) else short - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    order = np.argsort(i)
    i, j = i[order], j[order]
    near = np.abs(i - j) <= n - 2 * needed  # more insertions and deletions than that miss the threshold
    same = head + tail + _longest_rise(j[near])
    if same < needed and not near.all():
        same = head + tail + _longest_rise(j)
    return same >= needed and n > 0, n - 2 * same


def _longest_rise(values: np.ndarray) -> int:
    ends: list[int] = []  # smallest end of a rising chain of each length
    for x in values.tolist():
        at = bisect_left(ends, x)
        ends[at : at + 1] = [x]
    return len(ends)


def _words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _digest(words: list[str]) -> bytes:
    return xxhash.xxh3_128_digest(" ".join(words))


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make_room()
    memo = Words()
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            words = [_words(t) for t in batch.column(1).slice(start, SLICE).to_pylist()]
            found = [shingles(w, memo) for w in words]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).slice(start, SLICE),
                    batch.column(2).slice(start, SLICE),
                    pa.array([_digest(w) for w in words], pa.binary()),
                    pa.array(list(map(len, found)), pa.int64()),
                    pa.array([signatures(f).view(np.int64) for f in found], pa.list_(pa.int64())),
                    pa.array(list(map(parity, found)), pa.binary()),
                ],
                ["doc_id", "mark", "node", "size", "bands", "parity"],
            )


VERIFIED = "a binary, b binary, same boolean, distance long"


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        memo = Words()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                part = batch.slice(start, SLICE)
                got = [
                    aligned(shingles(_words(a), memo), shingles(_words(b), memo), threshold)
                    for a, b in zip(part.column("a_text").to_pylist(), part.column("b_text").to_pylist(), strict=True)
                ]
                columns = [part.column("a"), part.column("b"), pa.array([g[0] for g in got], pa.bool_()), pa.array([g[1] for g in got], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["a", "b", "same", "distance"])

    return run


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, same) of the pairs of nodes; only texts that a pair needs are moved."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes, "node")
    texts = needed.select("node", "doc_id", "mark").join(docs, ["doc_id", "mark"]).groupBy("node").agg(F.min("text").alias("text"))
    texts = written(texts, "neardup-texts")
    both = (
        pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a")
        .join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
        .select("a", "b", "a_text", "b_text")
    )
    result = written(both.mapInArrow(_verify(threshold), VERIFIED), "neardup-verified")
    drop_written(texts)
    return result


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label): the smallest node of each connected component, by label passing and pointer jumping."""
    edges = links.select(F.col(a).alias("x"), F.col(b).alias("y"))
    edges = written(edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x != y").distinct(), "links")
    labels = written(edges.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "labels")
    while True:
        heard = edges.join(labels.select(F.col("node").alias("y"), "label"), "y").groupBy(F.col("x").alias("node")).agg(F.min("label").alias("heard"))
        step = labels.join(heard, "node").select("node", F.col("label").alias("old"), F.least("label", "heard").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        passed = written(
            step.join(jump, "label").select("node", F.least("label", "further").alias("label"), (F.least("label", "further") != F.col("old")).alias("moved")),
            "labels",
        )
        moved = not passed.where("moved").isEmpty()
        drop_written(labels)
        labels = passed.select("node", "label")
        if not moved:
            drop_written(edges)
            return labels


_PACKED = np.dtype([("node", "u1", 16), ("label", "u1", 16), ("size", "<i8"), ("parity", "<u8", PARITY_BITS // 64)])


def _near(threshold: float):
    """Pairs of two blocks, in different classes, that their sketches do not rule out."""

    def found(x: np.ndarray, y: np.ndarray, same: bool) -> Iterator[tuple[bytes, bytes]]:
        label_x, label_y = (v["label"].copy().view("<u8").reshape(-1, 2) for v in (x, y))
        for start in range(0, len(x), 32):
            part = slice(start, start + 32)
            total = x["size"][part, None] + y["size"][None]
            needed = needed_of(total, threshold)
            ok = (label_x[part, None] != label_y[None]).any(-1) & (np.minimum(x["size"][part, None], y["size"][None]) >= needed)
            if same:
                ok &= np.arange(start, start + len(ok))[:, None] < np.arange(len(y))[None]
            i, j = np.nonzero(ok)
            for at in range(0, len(i), 8192):
                k, m = i[at : at + 8192], j[at : at + 8192]
                differ = np.bitwise_count(x["parity"][part][k] ^ y["parity"][m]).sum(1, dtype=np.int64)
                left = total[k, m] - differ >= 2 * needed[k, m]
                for a, b in zip(k[left].tolist(), m[left].tolist(), strict=True):
                    one, two = x["node"][start + a].tobytes(), y["node"][b].tobytes()
                    yield (one, two) if one < two else (two, one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = (np.frombuffer(b"".join(batch.column(c)[row].as_py()), _PACKED) for c in (0, 1))
                pairs = list(found(x, y, batch.column(2)[row].as_py()))
                a, b = zip(*pairs, strict=True) if pairs else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return run


def _remaining(members: DataFrame, nodes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: candidates in different classes that may reach the threshold.

    Large classes fill blocks of their own, which are not compared with each other. A bucket of many
    blocks is dealt to many tasks.
    """
    label = F.coalesce("label", "node")
    placed = written(members.join(labels, "node", "left").select("bucket", "node", "crowd", label.alias("label")), "neardup-placed")
    counts = placed.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    mixed = placed.join(counts, ["bucket", "label"]).where("n < crowd")
    large = F.col("n") > BLOCK
    block = F.when(large, F.xxhash64("label", F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / BLOCK)))).otherwise(
        F.pmod(F.xxhash64("label"), F.ceil(F.col("crowd") / BLOCK))
    )
    blocks = (
        mixed.select("bucket", "node", "label", "crowd", block.alias("block"), F.when(large, F.col("label")).alias("pure"))
        .join(nodes.select("node", "parity"), "node")
        .groupBy("bucket", "block")
        .agg(F.first("pure").alias("pure"), F.max("crowd").alias("crowd"), F.collect_list(F.concat("node", "label", "parity")).alias("texts"))
    )
    blocks = written(blocks.withColumn("salts", F.ceil(F.col("crowd") / (8 * BLOCK))), "neardup-blocks")
    x = blocks.select("bucket", F.pmod(F.xxhash64("block"), "salts").alias("salt"), *[F.col(c).alias(f"x_{c}") for c in ("block", "pure", "texts")])
    y = blocks.select("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), *[F.col(c).alias(f"y_{c}") for c in ("block", "pure", "texts")])
    both = x.join(y, ["bucket", "salt"]).where("x_block <= y_block AND (x_pure != y_pure OR x_pure IS NULL OR y_pure IS NULL)")
    pairs = both.select("x_texts", "y_texts", F.expr("x_block = y_block")).mapInArrow(_near(threshold), "a binary, b binary")
    with small_batches(pairs.sparkSession, BLOCKS_AT_ONCE):
        pairs = written(pairs.distinct(), "neardup-remaining")
    drop_written(blocks)
    drop_written(placed)
    return pairs


def _across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose nodes are not in one component."""
    of_a, of_b = (labels.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in "ab")
    label_a, label_b = F.coalesce("_a", "a"), F.coalesce("_b", "b")
    return pairs.join(of_a, "a", "left").join(of_b, "b", "left").where(label_a != label_b).drop("_a", "_b")


def _marked(docs: DataFrame, text: str) -> Column:
    """A hash of the text: rows that share an id are told apart by it."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def _classes(docs: DataFrame, threshold: float, text: str) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, mark, node), and per node (label, class_id, class_size, doc_id, mark); id and mark stand for the node's text."""
    with small_batches(docs.sparkSession):
        return _found(docs, threshold, text)


def _found(docs: DataFrame, threshold: float, text: str) -> tuple[DataFrame, DataFrame]:
    mark = _marked(docs, text).alias("mark")
    docs = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), mark).where("doc_id IS NOT NULL")
    sketch = "mark long, node binary, size long, bands array<bigint>, parity binary"
    rows = written(docs.mapInArrow(_sketches, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {sketch}"), "neardup-sketches")
    first = [F.first(c).alias(c) for c in ("size", "bands", "parity")]
    own = F.min(F.struct("doc_id", "mark")).alias("own")
    nodes = rows.groupBy("node").agg(own, F.count("*").alias("n"), *first)
    nodes = written(nodes.select("node", "own.*", "n", "size", "bands", "parity"), "neardup-nodes")
    places = nodes.select("node", F.explode("bands").alias("bucket"))
    crowds = places.groupBy("bucket").agg(F.count("*").alias("crowd")).where("crowd > 1")
    members = written(places.join(crowds, "bucket"), "neardup-members")
    degrees = members.groupBy("node").agg(F.sum("crowd").alias("degree"))
    hubs = members.join(degrees, "node").groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("hub"))
    spokes = written(members.join(hubs, "bucket").where("node != hub.node").select("bucket", "node", "hub"), "neardup-spokes")
    ids = nodes.select("node", "doc_id", "mark")

    # At first each text only meets the greatest of its hubs, then those of other classes.
    pairs = spokes.groupBy(F.col("node").alias("a")).agg(F.max("hub").alias("hub")).select("a", F.col("hub.node").alias("b"))
    tested = _verified(pairs, ids, docs, threshold)
    labels = components(tested.where("same"))
    pairs = spokes.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct()
    untested = _across(pairs, labels).join(tested, ["a", "b"], "left_anti")
    tested = tested.unionByName(_verified(written(untested, "neardup-pairs"), ids, docs, threshold))
    labels = components(tested.where("same"))
    drop_written(spokes)

    # All other candidates of different classes.
    done = tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    untested = written(_remaining(members, nodes, labels, threshold).join(done, ["a", "b"], "left_anti"), "neardup-pairs")
    tested = tested.unionByName(_verified(untested, ids, docs, threshold))
    labels = components(tested.where("same"))

    labelled = nodes.select("node", "doc_id", "mark", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size"))
    return rows.select("doc_id", "mark", "node"), labelled.join(classes, "label").drop("n")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """(doc_id, class_id, class_size): one row per row of docs with an id; a class is named by its smallest id.

    Rows that share an id are told apart by their texts, and each gets the class of its text.
    """
    rows, named = _classes(docs, threshold, text)
    return rows.select("doc_id", "node").join(named.select("node", "class_id", "class_size"), "node").select("doc_id", "class_id", "class_size")


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs with one row of each class: the one with the smallest id, and of its texts one. Rows without an id stay."""
    _, named = _classes(docs, threshold, text)
    kept = named.groupBy("label").agg(F.min(F.struct("doc_id", "mark")).alias("kept")).select("kept.doc_id", F.col("kept.mark").alias("_mark"))
    rest = docs.where("doc_id IS NULL")
    once = docs.withColumn("_mark", _marked(docs, text)).join(kept, ["doc_id", "_mark"], "left_semi")
    return once.dropDuplicates(["doc_id", "_mark"]).select(*docs.columns).unionByName(rest)


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
