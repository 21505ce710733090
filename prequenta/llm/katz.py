"""Katz backoff language model of order 2, learnt and evaluated in two passes over the texts.

    P(w | h) = d(c(h, w)) c(h, w) / c(h)     if c(h, w) > 0
             = alpha(h) P(w)                 otherwise
    P(w)     = d1(c(w)) c(w) / N             if c(w) > 0
             = what that leaves              for all unknown words together

d are Good-Turing discounts for counts up to ``MAX_DISCOUNTED`` from the corpus' counts of counts,
and alpha(h) makes each history sum to exactly 1: alpha(h) = (1 - seen mass of h) / (1 - P of the
words seen after h). A history of which no count is discounted is given one more occurrence, so
that it too leaves mass. The first history of a text is a start mark; every text ends in an end token.

Pass 1 counts words. The most frequent, at most ``HEAD_WORDS``, get short codes and are broadcast with
their counts (the bound is the parameter); all other words go by 63-bit hash. Pass 2 packs the bigram
occurrences of a block of texts per bucket of histories and ships them once. A bucket then holds
all occurrences of its bigrams, so it yields the parts of alpha, and for every text the sums that need
no further lookup: counts of counts and logarithms, from which the discounts, known only at the end,
give the score. Counts of bigrams are used where they arise and not stored. Very frequent
histories are dealt to buckets in proportion to their share, by the next word. Only bigrams that
were never seen, which held-out texts alone have, look up alpha(h) and P(w).

Edge cases: NULL and empty texts are the end token alone; without training texts every word is
unknown and has probability 1; repeated rows are scored (and learnt) each; a NULL id counts as the
empty id in the split; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from contextlib import AbstractContextManager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prequenta.llm.common import BATCH_ROWS, bucket_of, drop_written, make_room, small_batches, table, written

FOLDS = 7
HELD_OUT = 2
MAX_DISCOUNTED = 5
HEAD_WORDS = 1 << 16
BLOCK_TOKENS = 1 << 18
BUCKET_TOKENS = 400_000
MEMO_WORDS = 100_000
HISTORIES_A_ROW = 2_048  # and other parts of a bucket: rows of some 100 kB, whatever its size
READ_ROWS = 256  # wide rows that are read from a table at once
COUNT_BITS = 20  # of a packed count
MOST = (1 << COUNT_BITS) - 1
READ_AT_ONCE = "spark.sql.parquet.columnarReaderBatchSize"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

END, START, FIRST = 1, 2, 16  # codes; head words follow from FIRST on
_TAIL = np.uint64(1 << 63)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def tokens_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()


def _hash(word: bytes) -> int:
    return max(FIRST, xxhash.xxh3_64_intdigest(word) >> 1)


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    x = (a * _C1) ^ b
    x = (x ^ (x >> np.uint64(32))) * _C2
    return x ^ (x >> np.uint64(29))


def count_words(texts: DataFrame) -> DataFrame:
    """(w, c) of the words of all texts, by hash; END stands for the end token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        counts: Counter[bytes] = Counter()
        ends = 0

        def flush() -> pa.RecordBatch:
            w = [_hash(t) for t in counts] + [END]
            out = pa.RecordBatch.from_arrays([pa.array(w, pa.int64()), pa.array([*counts.values(), ends], pa.int64())], ["w", "c"])
            counts.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(tokens_of(text))
                ends += 1
            if len(counts) > 2 * MEMO_WORDS:
                yield flush()
                ends = 0
        yield flush()

    return texts.mapInArrow(count, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")).where("c > 0")


def discounts(n: list[float], k: int = MAX_DISCOUNTED) -> np.ndarray:
    """Good-Turing discount of counts 1..k, from counts of counts n[0..k+1].

    Always between 0 and 1: r / (r + 1) where the counts of counts give nothing of use.
    """
    out = np.arange(k + 1) / (np.arange(k + 1) + 1.0)
    out[0] = 1.0  # also stands for all greater counts
    if n[1] <= 0:
        return out
    tail = (k + 1) * n[k + 1] / n[1]
    for r in range(1, k + 1):
        if n[r] > 0 and tail < 1:
            d = ((r + 1) * n[r + 1] / (r * n[r]) - tail) / (1 - tail)
            if 0 < d < 1:
                out[r] = d
    return out


class Head:
    """The most frequent words: code and count; and what all tasks share."""

    def __init__(self, words: list[int], counts: list[int], n_texts: int, n_buckets: int, total: int, vocabulary: int, d1: np.ndarray):
        self.words, self.n_buckets, self.total, self.vocabulary = words, n_buckets, total, vocabulary
        self.count = np.zeros(FIRST + len(words), np.int64)
        self.count[FIRST:] = counts
        self.count[[END, START]] = n_texts
        self.d1 = d1
        # Buckets over which a history is spread: by its share of all occurrences.
        self.salts = np.maximum(1, np.ceil(8.0 * n_buckets * self.count / max(total, 1))).astype(np.uint64)
        with np.errstate(divide="ignore"):
            self.p = d1[np.minimum(self.count, len(d1) - 1) * (self.count < len(d1))] * self.count / max(total, 1)

    def codes(self) -> dict[int, int]:
        return {w: FIRST + i for i, w in enumerate(self.words)}


class Codes(dict):
    def __init__(self, head: dict[int, int]):
        self.head = head

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        value = _hash(word)
        self[word] = code = self.head.get(value, value | (1 << 63))
        return code


def _planes(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unplanes(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(8, n).T.copy().view("<u8").ravel()


def _pack_bucket(h: np.ndarray, w: np.ndarray, doc: np.ndarray, train: np.ndarray) -> bytes:
    """Different bigrams once, with the texts of their occurrences; input is sorted by bigram."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
    times = np.diff(np.append(np.flatnonzero(new), len(h))).astype("<u4")
    head = np.array([new.sum(), len(doc), len(train)], "<i8").tobytes()
    return pa.compress(
        head + _planes(h[new]) + _planes(w[new]) + times.tobytes() + doc.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() + np.packbits(train).tobytes(),
        codec="zstd",
        asbytes=True,
    )


def _unpack_bucket(blob: bytes, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data = pa.decompress(blob, decompressed_size=size, codec="zstd", asbytes=True)
    pairs, refs, docs = np.frombuffer(data[:24], "<i8").tolist()
    at = 24
    h = _unplanes(data[at : at + 8 * pairs], pairs)
    at += 8 * pairs
    w = _unplanes(data[at : at + 8 * pairs], pairs)
    at += 8 * pairs
    times = np.frombuffer(data[at : at + 4 * pairs], "<u4")
    at += 4 * pairs
    doc = np.frombuffer(data[at : at + 4 * refs], np.uint8).reshape(4, refs).T.copy().view("<u4").ravel()
    train = np.unpackbits(np.frombuffer(data[at + 4 * refs :], np.uint8), count=docs).astype(bool)
    return h, w, times, doc, train


def _pack_counts(counts: np.ndarray) -> np.ndarray:
    """Rows of counts below 2**COUNT_BITS, three rows to a long."""
    packed = np.zeros((-(-len(counts) // 3), counts.shape[1]), np.int64)
    for r, row in enumerate(counts):
        packed[r // 3] |= row << (COUNT_BITS * (r % 3))
    return packed.ravel()


def _unpack_counts(packed: np.ndarray, rows: int, columns: int) -> np.ndarray:
    packed = packed.reshape(-1, columns)
    return np.stack([packed[r // 3] >> (COUNT_BITS * (r % 3)) & ((1 << COUNT_BITS) - 1) for r in range(rows)])


SHIPPED = "bucket int, block long, size int, blob binary"


def _ship(head):
    """Pass 2: bigram occurrences of blocks of texts, packed per bucket. bucket -1 lists the block's texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        shared: Head = head.value
        memo = Codes(shared.codes())
        n_buckets, part, number = np.uint64(shared.n_buckets), TaskContext.get().partitionId(), 0
        codes: list[np.ndarray] = []
        trained: list[bool] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, held
            w = np.concatenate(codes)
            sizes = np.array([len(c) for c in codes])
            doc = np.repeat(np.arange(len(codes)), sizes)
            h = np.empty_like(w)
            h[1:] = w[:-1]
            h[np.cumsum(sizes) - sizes] = START
            salts = np.ones(len(h), np.uint64)
            short = h < _TAIL
            salts[short] = shared.salts[h[short].astype(np.int64)]
            bucket = _mix(h, _mix(w, _C1) % salts) % n_buckets
            order = np.lexsort((w, h, bucket))
            h, w, doc, bucket = h[order], w[order], doc[order], bucket[order]
            cut = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
            train = np.array(trained)
            rows = []
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                blob = _pack_bucket(h[a:b], w[a:b], doc[a:b], train)
                pairs = int(1 + ((h[a + 1 : b] != h[a : b - 1]) | (w[a + 1 : b] != w[a : b - 1])).sum())
                size = 24 + 20 * pairs + 4 * int(b - a) + -(-len(train) // 8)
                rows.append((int(bucket[a]), (part << 32) | number, size, blob))
            number, held = number + 1, 0
            codes.clear()
            trained.clear()
            kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["bucket", "block", "size", "blob"]
            )

        for batch in batches:
            for text, train in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = tokens_of(text)
                code = np.empty(len(words) + 1, np.uint64)
                code[:-1] = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
                code[-1] = END
                codes.append(code)
                trained.append(train)
                held += len(code)
                if held >= BLOCK_TOKENS:
                    yield flush()
        if codes:
            yield flush()

    return run


# kind 0: sums per text of a block; 1: unseen bigrams; 3: histories; 4: rare words seen after a history;
# 5: seen bigrams of spread histories that may need one more occurrence.
REDUCED = (
    "kind int, block long, doc array<int>, h array<long>, w array<long>, n array<long>, known array<int>, base array<double>, logs array<double>, bucket int"
)


def _reduce(head):
    k = MAX_DISCOUNTED

    def run(rows: pa.Table) -> pa.Table:
        shared: Head = head.value
        size, blobs = rows.column("size").to_pylist(), rows.column("blob").to_pylist()
        parts = [_unpack_bucket(b, s) for b, s in zip(blobs, size, strict=True)]
        blocks = rows.column("block").to_pylist()
        h, w = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
        order = np.lexsort((w, h))
        hs, ws = h[order], w[order]
        new = np.ones(len(h), bool)
        new[1:] = (hs[1:] != hs[:-1]) | (ws[1:] != ws[:-1])
        number = np.empty(len(h), np.int64)
        number[order] = np.cumsum(new) - 1
        uh, uw = hs[new], ws[new]
        count = np.zeros(len(uh), np.int64)
        start = 0
        refs = []
        for p in parts:
            pair = np.repeat(number[start : start + len(p[0])], p[2])
            start += len(p[0])
            refs.append(pair)
            count += np.bincount(pair[p[4][p[3]]], minlength=len(uh))
        # Histories of this bucket.
        first = np.ones(len(uh), bool)
        first[1:] = uh[1:] != uh[:-1]
        history = np.cumsum(first) - 1
        vh = uh[first]
        here = np.bincount(history, count).astype(np.int64)
        short = vh < _TAIL
        total = here.copy()
        total[short] = shared.count[vh[short].astype(np.int64)]
        low = np.stack([np.bincount(history, (count == r).astype(np.int64), len(vh)) for r in range(1, k + 2)]).astype(np.int64)
        alone = np.ones(len(vh), bool)
        alone[short] = shared.salts[vh[short].astype(np.int64)] == 1
        # One more occurrence where nothing would be left for unseen words.
        extra = (alone & (here > 0) & (low[:k].sum(0) == 0)).astype(np.int64)
        with np.errstate(divide="ignore"):
            log_total, log_count = np.log10(total + extra), np.log10(count)
            log_base = np.log10((total + 1) / (shared.total + shared.vocabulary + 1))
        small_w = uw < _TAIL
        p = np.zeros(len(uw))
        p[small_w] = shared.p[uw[small_w].astype(np.int64)]
        seen = count > 0
        mass = np.bincount(history, p * seen, len(vh))

        out = {f.split()[0]: [] for f in REDUCED.split(", ")}
        bucket = rows.column("bucket")[0].as_py()

        def add(kind, block=None, doc=None, h=None, w=None, n=None, known=None, base=None, logs=None):
            for name, value in zip(out, (kind, block, doc, h, w, n, known, base, logs, bucket), strict=True):
                out[name].append(value)

        for block, p_, pair in zip(blocks, parts, refs, strict=True):
            doc, n_docs = p_[3].astype(np.int64), len(p_[4])
            c, hist = count[pair], history[pair]
            ok = c > 0
            touched = np.flatnonzero(np.bincount(doc, minlength=n_docs))
            word = vh[hist] != START
            known = np.bincount(doc, (word & (total[hist] > 0)), n_docs)[touched]
            base = np.bincount(doc, np.where(word, log_base[hist], 0.0), n_docs)[touched]
            logs = np.bincount(doc[ok], log_count[pair[ok]] - log_total[hist[ok]], n_docs)[touched]
            few = np.stack([np.bincount(doc, c == r, n_docs)[touched] for r in range(1, k + 1)]).astype(np.int64)
            add(0, block, touched.astype(np.int32), n=_pack_counts(np.minimum(few, MOST)), known=known.astype(np.int32), base=base, logs=logs)
            while (few > MOST).any():  # of a text of a million words and more: the rest goes into rows of its own
                few = np.maximum(few - MOST, 0)
                nothing = np.zeros(len(touched))
                add(0, block, touched.astype(np.int32), n=_pack_counts(np.minimum(few, MOST)), known=nothing.astype(np.int32), base=nothing, logs=nothing)
            # A spread history of which this bucket has no low count: its other buckets decide.
            unsure = ok & (~alone[hist]) & (low[:k].sum(0) == 0)[hist]
            if unsure.any():
                add(5, block, doc[unsure].astype(np.int32), vh[hist[unsure]].view(np.int64))
            if not ok.all():
                miss = ~ok
                add(1, block, doc[miss].astype(np.int32), uh[pair[miss]].view(np.int64), uw[pair[miss]].view(np.int64))
        used, rare = np.flatnonzero(here > 0), np.flatnonzero(seen & ~small_w)
        for start in range(0, len(used), HISTORIES_A_ROW):
            use = used[start : start + HISTORIES_A_ROW]
            add(3, h=vh[use].view(np.int64), n=np.concatenate([here[use], extra[use], *(row[use] for row in low)]), logs=mass[use])
        for start in range(0, len(rare), 4 * HISTORIES_A_ROW):
            some = rare[start : start + 4 * HISTORIES_A_ROW]
            add(4, h=uh[some].view(np.int64), w=uw[some].view(np.int64))
        kinds = [pa.int32(), pa.int64(), *[pa.list_(t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64())], pa.int32()]
        # In batches of a few rows, which the executor holds one at a time.
        batches = (
            pa.RecordBatch.from_arrays([pa.array(values[at : at + READ_ROWS], t) for values, t in zip(out.values(), kinds, strict=True)], list(out))
            for at in range(0, len(out["kind"]), READ_ROWS)
        )
        return pa.Table.from_batches(batches, pa.schema(list(zip(out, kinds, strict=True))))

    return run


def _texts(d: np.ndarray, head):
    """Sums of all buckets per text of a block; score without the unseen bigrams."""
    k = MAX_DISCOUNTED
    log_d = np.log10(d[1:])

    def run(rows: pa.Table) -> pa.Table:
        n_docs = 1 + pc.max(pc.list_flatten(rows.column("doc"))).as_py()
        known, base, score = np.zeros(n_docs, np.int64), np.zeros(n_docs), np.zeros(n_docs)
        for i in range(rows.num_rows):
            doc = np.asarray(rows.column("doc")[i].values)
            known[doc] += np.asarray(rows.column("known")[i].values)
            base[doc] += np.asarray(rows.column("base")[i].values)
            few = _unpack_counts(np.asarray(rows.column("n")[i].values), k, len(doc))
            score[doc] += np.asarray(rows.column("logs")[i].values) + log_d @ few
        block = rows.column("block")[0].as_py()
        return pa.table({"block": pa.array([block] * n_docs, pa.int64()), "doc": pa.array(np.arange(n_docs), pa.int32()), "known": known, "base": base, "sum": score})

    return run


def _listed(n_of: int):
    """doc_id and size of each text, numbered as pass 2 numbers them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, doc, held = TaskContext.get().partitionId(), 0, 0, 0
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                n = len(tokens_of(text)) + 1
                rows.append(((part << 32) | number, doc, n))
                doc, held = doc + 1, held + n
                if held >= n_of:
                    number, doc, held = number + 1, 0, 0
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64()), strict=True)], batch.column(2)],
                ["doc_id", "block", "doc", "n_tokens", "train"],
            )

    return run


def _head_words(words: DataFrame) -> DataFrame:
    """The words of the highest counts, at most ``HEAD_WORDS``: from how many words have counts of the same 64th of a factor of two."""
    level = F.floor(F.log2("c") * 64)
    real = words.where(F.col("w") != END)
    cut, places = None, HEAD_WORDS
    for row in real.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect():  # 64 * 63 rows at most
        places -= row["n"]
        if places < 0:
            break
        cut = row["level"]
    return real.where(F.lit(False) if cut is None else level >= cut)


def _sparing(spark: SparkSession) -> AbstractContextManager[None]:
    """While the tables are written, texts travel to Python and wide rows are read a few megabytes at a time, and the
    shuffle files of a table go when it is written, not when the driver next collects garbage."""
    rows = min(int(spark.conf.get(READ_AT_ONCE)), READ_ROWS)
    return small_batches(spark, more={READ_AT_ONCE: str(rows), DROP_SHUFFLES: "true"})


def score_texts(docs: DataFrame, train: Column, text: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every text."""
    with _sparing(docs.sparkSession):
        return _scored(docs, train, text)


def _scored(docs: DataFrame, train: Column, text: str) -> DataFrame:
    spark, k = docs.sparkSession, MAX_DISCOUNTED
    rows = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"), train.alias("train"))
    words = written(count_words(rows.where("train").select("text")), "katz-words")
    stats = words.agg(
        F.sum("c").alias("total"), F.count("*").alias("v"), F.max(F.when(F.col("w") == END, F.col("c"))).alias("texts"),
        *[F.count(F.when(F.col("c") == r, 1)).alias(f"n{r}") for r in range(1, k + 2)],
    ).first()
    total, vocabulary = stats["total"] or 0, stats["v"]
    d1 = discounts([0, *[stats[f"n{r}"] for r in range(1, k + 2)]])
    top = _head_words(words).toPandas().sort_values(["c", "w"], ascending=[False, True])
    n_buckets = max(1, -(-total // BUCKET_TOKENS))
    shared = Head(top["w"].tolist(), top["c"].tolist(), stats["texts"] or 0, n_buckets, total, vocabulary, d1)
    head = spark.sparkContext.broadcast(shared)

    shipped = rows.select("text", "train").mapInArrow(_ship(head), SHIPPED)
    reduced = written(shipped.groupBy("bucket").applyInArrow(_reduce(head), REDUCED), "katz-model")

    # Histories: counts, and the mass of the words seen after them.
    size = F.size("h")
    parts = reduced.where("kind = 3").select("h", "n", "logs", size.alias("size"))
    history = parts.select(F.posexplode("h").alias("i", "history"), "n", "logs", "size").select(
        "history", F.element_at("logs", F.col("i") + 1).alias("mass"), *[F.element_at("n", F.col("i") + 1 + F.lit(j) * F.col("size")).alias(f"s{j}") for j in range(k + 3)]
    )
    low = reduced.where("kind = 3").select(
        *[F.aggregate(F.slice("n", F.lit(j) * size + 1, size), F.lit(0).cast("long"), lambda a, x: a + x).alias(f"t{j}") for j in range(2, k + 3)]
    ).agg(*[F.sum(f"t{j}").alias(f"t{j}") for j in range(2, k + 3)]).first()
    d = discounts([0, *[low[f"t{j}"] or 0 for j in range(2, k + 3)]])
    word_p = F.lit(0.0)
    for r in range(1, k + 1):
        word_p = F.when(F.col("c") == r, F.lit(float(d1[r]) * r / max(total, 1))).otherwise(word_p)
    word_p = F.when(F.col("c") > k, F.col("c") / max(total, 1)).otherwise(word_p)
    rare_words = words.join(F.broadcast(spark.createDataFrame(top[["w"]])) if len(top) else words.limit(0).select("w"), "w", "left_anti").where(F.col("w") != END)
    rare_p = rare_words.select((F.col("w").bitwiseOR(F.lit(-(1 << 63)))).alias("word"), word_p.alias("p"))
    known_mass = words.agg(F.sum(word_p)).first()[0] or 0.0
    unknown = max(1.0 - known_mass, 1e-12) if total else 1.0

    after = reduced.where("kind = 4").select(F.explode(F.arrays_zip("h", "w")).alias("x")).select(F.col("x.h").alias("history"), F.col("x.w").alias("word"))
    rare_mass = after.join(rare_p, "word").groupBy("history").agg(F.sum("p").alias("mass"))
    sums = history.unionByName(rare_mass.select("history", "mass", *[F.lit(0).cast("long").alias(f"s{j}") for j in range(k + 3)]))
    sums = sums.groupBy("history").agg(*[F.sum(c).alias(c) for c in ("mass", *[f"s{j}" for j in range(k + 3)])])
    cut = sum((F.col(f"s{r + 1}") * F.lit(float((1 - d[r]) * r)) for r in range(1, k + 1)), F.lit(0.0))
    no_low = sum((F.col(f"s{r + 1}") for r in range(1, k + 1)), F.lit(0)) == 0
    left = F.when(no_low, F.lit(1.0) / (F.col("s0") + 1)).otherwise(cut / F.col("s0"))
    alpha = written(sums.select("history", F.log10(left / F.greatest(1 - F.col("mass"), F.lit(unknown))).alias("log_alpha")), "katz-alpha")

    # Unseen bigrams of held-out texts. Short codes are looked up in tables of bounded size.
    unseen = reduced.where("kind = 1").select("block", F.explode(F.arrays_zip("doc", "h", "w")).alias("x")).select(
        "block", F.col("x.doc").alias("doc"), F.col("x.h").alias("history"), F.col("x.w").alias("word")
    )
    head_p = spark.createDataFrame([(int(c), float(p)) for c, p in enumerate(shared.p) if p > 0] or [(0, 1.0)], "word long, p double")

    def looked_up(key: str, head_table: DataFrame, rest: DataFrame, value: Column) -> DataFrame:
        counted = unseen.groupBy("block", "doc", key).agg(F.count("*").alias("n"))
        near = counted.where(F.col(key) >= 0).join(F.broadcast(head_table), key, "left")
        far = counted.where(F.col(key) < 0).join(rest, key, "left")
        return near.unionByName(far).groupBy("block", "doc").agg(F.sum(F.col("n") * value).alias("part"))

    by_history = looked_up("history", alpha.where("history >= 0"), alpha.where("history < 0"), F.coalesce("log_alpha", F.lit(0.0)))
    by_word = looked_up("word", head_p, rare_p, F.log10(F.coalesce("p", F.lit(unknown))))
    spread = reduced.where("kind = 5").select("block", F.explode(F.arrays_zip("doc", "h")).alias("x")).select(
        "block", F.col("x.doc").alias("doc"), F.col("x.h").alias("history")
    )
    undiscounted = sums.where(no_low & (F.col("s1") == 0)).select("history", "s0")
    raised = spread.groupBy("block", "doc", "history").agg(F.count("*").alias("n")).join(undiscounted, "history")
    raised = raised.groupBy("block", "doc").agg(F.sum(-F.col("n") * F.log10((F.col("s0") + 1) / F.col("s0"))).alias("part"))
    # One after the other, so that Python workers of several stages never share an executor.
    backed = by_history.unionByName(by_word).unionByName(raised).groupBy("block", "doc").agg(F.sum("part").alias("part"))
    backed = written(backed, "katz-unseen")
    per_text = reduced.where("kind = 0").groupBy("block").applyInArrow(_texts(d, head), "block long, doc int, known long, base double, sum double")
    per_text = written(per_text, "katz-texts")
    for used in (words, reduced, alpha):
        drop_written(used)
    listed = rows.select("doc_id", "text", "train").mapInArrow(
        _listed(BLOCK_TOKENS), rows.select("doc_id", F.lit(0).cast("long").alias("block"), F.lit(0).alias("doc"), F.lit(0).cast("long").alias("n_tokens"), "train").schema
    )
    listed = written(listed, "katz-rows")
    head.destroy()
    ends = float(np.log10((shared.count[END] + 1) / (total + vocabulary + 1)))
    known_end = int(shared.count[END] > 0)
    return (
        listed.join(per_text, ["block", "doc"])
        .join(backed, ["block", "doc"], "left")
        .select(
            "doc_id",
            (~F.col("train")).alias("held_out"),
            "n_tokens",
            (F.col("known") + known_end).alias("n_known"),
            F.lit(total).cast("long").alias("train_tokens"),
            (F.col("base") + ends).alias("base_score"),
            (F.col("sum") + F.coalesce("part", F.lit(0.0))).alias("score"),
        )
    )


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score_texts(docs, bucket_of(F.col("doc_id"), FOLDS) != HELD_OUT)
