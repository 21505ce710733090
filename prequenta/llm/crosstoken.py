"""Two tokenizers aligned on the bytes of each text, with corpus-wide counts of linked token pairs.

Method: exact-text deduplication. Documents are shuffled by their full text, and each distinct text
is tokenised by both and aligned once. Byte offsets where tokens of both end cut the text into
groups; the two tokens that end there are linked. Links of a text count as often as the corpus
holds it. The measures of a text, which look at the corpus-wide counts of its links, are joined to
all documents that hold it.

Distinct texts are aligned in blocks of about ``BLOCK_BYTES`` bytes. A block is one row with its
distinct id pairs, so that what is shuffled to count pairs, and to bring the counts back, is one
row per pair and block and not one per link. The best count per id of B is a table of at most the
vocabulary's rows. A text that more than one ``HOT_SHARE``-th of all rows hold is joined in slices:
there are at most ``HOT_SHARE`` such texts and twice that many slices whatever the input's size, so
that list is the one thing that is broadcast besides the best counts.

A's ids are those of its library. Texts that hold nothing beyond U+017F, where no two versions of
Unicode tell letters, numbers and white space apart differently, get the same ids several times
faster from the vocabulary's ranks; others, and very long ones, are encoded by the library itself.

A's text is a blank and the text, B adds its blank itself. Bytes of A's tokens are their entries
decoded from the byte-level alphabet; of B's, the piece in UTF-8 with U+2581 as a blank, and the
byte of a byte piece. Special tokens' strings in texts are plain text.

Edge cases: texts that are NULL, empty, or whose joined bytes of A or B differ from the blank and
the text have no tokens: all measures 0 and the groups ''. Very long texts are blocks of their own.
Repeated rows get a row each and count each; rows with NULL ids too. Other columns are ignored. An
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prequenta.llm.common import drop_when_released, drop_written, table, written

BLOCK_BYTES = 2_000_000
LIBRARY_CHARS = 100_000  # texts from which on A's library encodes, whose time grows least with the length of a word
HOT_SHARE = 2_000
MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
TEXT = "struct<digest:binary,n_a:bigint,n_b:bigint,n_links:bigint,groups:string>"
#: at: for each text the links' places in ``pairs``, one after the other; upto: where they end; weights: links of the block, with copies.
BLOCK = f"block string, texts array<{TEXT}>, pairs array<long>, weights array<long>, at array<int>, upto array<int>"


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of a byte-level vocabulary: printable ones stand for themselves, others follow from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """Both tokenizers, and the bytes of every id."""

    def __init__(self, a_file: str, b_file: str) -> None:
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for entry, i in vocabulary.items():
            known = all(c in alphabet for c in entry)
            self.a_bytes[i] = bytes(alphabet[c] for c in entry) if known else entry.encode()
        special = {t.content for t in self.a.get_added_tokens_decoder().values()}
        ranks = {self.a_bytes[i]: i for entry, i in self.a.get_vocab().items() if entry not in special}
        self.ranked = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        self.b_bytes = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        sizes = np.array([len(p) for p in self.a_bytes], np.int64)
        self.a_sizes, self.b_sizes = sizes, np.array([len(p) for p in self.b_bytes], np.int64)
        # Decimal ids with what may follow them: of A within and at the end of a group, of B likewise.
        n, m = len(sizes), len(self.b_bytes)
        self.written = [f"{i}{end}" for many, end in ((n, ","), (n, "|"), (m, ","), (m, ";")) for i in range(many)]

    @staticmethod
    def _piece(piece: str) -> bytes:
        byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
        return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()

    def ids_of_a(self, text: str) -> list[int]:
        if len(text) < LIBRARY_CHARS and (text.isascii() or max(text) < "\u0180"):
            return self.ranked.encode_ordinary(text)
        return self.a.encode(text, add_special_tokens=False).ids

    def aligned(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None]:
        """Per text the ids of A and B, and the places in them of the tokens that end together; None if it has no tokens."""
        of_b = self.b.encode(texts, num_threads=1)
        for text, b in zip(texts, of_b, strict=True):
            a, whole = self.ids_of_a(" " + text), b" " + text.encode()
            if not text or b"".join(map(self.b_bytes.__getitem__, b)) != whole or b"".join(map(self.a_bytes.__getitem__, a)) != whole:
                yield None
                continue
            a, b = np.array(a, np.int64), np.array(b, np.int64)
            ends_a, ends_b = self.a_sizes[a].cumsum(), self.b_sizes[b].cumsum()
            place = ends_a.searchsorted(ends_b)  # both end with the text, so there is always a place
            at_b = np.flatnonzero(ends_a[place] == ends_b)
            yield a, b, place[at_b], at_b

    def groups(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> str:
        """``a1,a2|b1;a3|b2,b3``: the ids of A and B between two cuts."""
        n, m = len(self.a_sizes), len(self.b_sizes)
        a, b = a.copy(), b + 2 * n
        group_a, group_b = at_a.searchsorted(np.arange(len(a))), at_b.searchsorted(np.arange(len(b)))
        a[at_a] += n
        b[at_b] += m
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        return "".join(map(self.written.__getitem__, np.concatenate([a, b])[order].tolist()))[:-1]


@lru_cache(maxsize=1)
def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    return Tokenizers(a_file, b_file)


def _in_blocks(a_file: str, b_file: str):
    """Distinct texts to rows of ``BLOCK``."""

    def block(number: int, texts: list[dict], links: list[np.ndarray], copies: list[int]) -> pa.RecordBatch:
        every = np.concatenate(links)
        pairs, at = np.unique(every, return_inverse=True)
        sizes = [len(x) for x in links]
        weights = np.bincount(at, weights=np.repeat(np.array(copies, float), sizes), minlength=len(pairs))
        row = {
            "block": f"{TaskContext.get().partitionId()}-{number}",
            "texts": texts,
            "pairs": pairs,
            "weights": np.rint(weights).astype(np.int64),
            "at": at.astype(np.int32),
            "upto": np.cumsum(sizes).astype(np.int32),
        }
        return pa.RecordBatch.from_pylist([row], BLOCK_ROW)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers(a_file, b_file)
        number = size = 0
        texts, links, copies = [], [], []
        for batch in batches:
            for start in range(0, batch.num_rows, 16):
                piece = batch.slice(start, 16)
                given = piece.column("text").to_pylist()
                for digest, n, text, found in zip(
                    piece.column("digest").to_pylist(), piece.column("n").to_pylist(), given, both.aligned(given), strict=True
                ):
                    if found is None:
                        continue
                    a, b, at_a, at_b = found
                    texts.append({"digest": digest, "n_a": len(a), "n_b": len(b), "n_links": len(at_a), "groups": hashlib.sha256(both.groups(*found).encode()).hexdigest()})
                    links.append(a[at_a] << 32 | b[at_b])
                    copies.append(n)
                    size += len(text)
                    if size >= BLOCK_BYTES:
                        yield block(number, texts, links, copies)
                        number, size, texts, links, copies = number + 1, 0, [], [], []
        if texts:
            yield block(number, texts, links, copies)

    return run


BLOCK_ROW = pa.schema(
    [
        ("block", pa.string()),
        ("texts", pa.list_(pa.struct([("digest", pa.binary()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_links", pa.int64()), ("groups", pa.string())]))),
        ("pairs", pa.list_(pa.int64())),
        ("weights", pa.list_(pa.int64())),
        ("at", pa.list_(pa.int32())),
        ("upto", pa.list_(pa.int32())),
    ]
)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the counts of their pairs to one row per text."""
    for batch in batches:
        for i in range(batch.num_rows):
            counts = batch.column("counts")[i].values
            order = np.argsort(counts.field("pair").to_numpy())
            count = counts.field("count").to_numpy()[order]
            best = counts.field("best").to_numpy(zero_copy_only=False)[order]
            at, upto = batch.column("at")[i].values.to_numpy(), batch.column("upto")[i].values.to_numpy()
            whole = np.concatenate([[0], np.cumsum(count[at])])
            top = np.concatenate([[0], np.cumsum(best[at].astype(np.int64))])
            start = np.concatenate([[0], upto[:-1]])
            texts = batch.column("texts")[i].values
            arrays = [texts.field(c) for c in ("digest", "n_a", "n_b", "n_links", "n_links")]
            arrays += [pa.array(top[upto] - top[start]), pa.array(whole[upto] - whole[start]), texts.field("groups")]
            yield pa.RecordBatch.from_arrays(arrays, ["digest", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


MEASURED = "digest binary, " + ", ".join(f"{m} long" for m in MEASURES) + ", groups string"


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): how many links hold the pair, and whether its B id has no pair with more."""
    pairs = blocks.select(F.explode(F.arrays_zip("pairs", "weights")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.weights").alias("w"))
    counts = written(pairs.groupBy("pair").agg(F.sum("w").alias("count")), "linked-pairs")
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    most = counts.groupBy(b.alias("b")).agg(F.max("count").alias("most"))  # at most a row per id of B
    return counts.withColumn("b", b).join(F.broadcast(most), "b").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_file: str, b_file: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256), one row per document."""
    source = docs.select(F.col(id_column).alias("id"), F.col(text).cast("string").alias("text"))
    digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    distinct = source.where("length(text) > 0").groupBy("text").agg(F.count("*").alias("n"))
    distinct = distinct.select(digest.alias("digest"), "n", "text")
    blocks = written(distinct.mapInArrow(_in_blocks(a_file, b_file), BLOCK), "aligned-blocks")
    counted = pair_counts(blocks)
    resolved = (
        blocks.select("block", F.explode("pairs").alias("pair"))
        .join(counted, "pair")
        .groupBy("block")
        .agg(F.collect_list(F.struct("pair", "count", "best")).alias("counts"))  # the pairs of one block
    )
    measured = blocks.select("block", "texts", "at", "upto").join(resolved, "block").mapInArrow(_measured, MEASURED)
    measured = written(measured, "aligned-texts")
    drop_written(counted)
    drop_when_released(blocks)
    del blocks
    return _to_documents(source.select("id", digest.alias("digest")), measured).withColumnRenamed("id", id_column)


def _to_documents(docs: DataFrame, measured: DataFrame) -> DataFrame:
    """Measures joined to all rows by the text's digest; rows of a text that many hold are dealt over slices."""
    docs = written(docs, "text-digests")
    rows = docs.count()
    copies = docs.groupBy("digest").agg(F.count("*").alias("n")).where(F.col("digest").isNotNull() & (F.col("n") * HOT_SHARE > rows))
    # Texts of more than rows / HOT_SHARE rows: fewer than HOT_SHARE of them, and their slices sum up to less than twice that.
    hot = written(copies.select("digest", F.ceil(F.col("n") * HOT_SHARE / max(rows, 1)).cast("int").alias("slices")), "hot-texts")
    # Rows without a text match nothing and may lie anywhere.
    slices = F.when(F.col("digest").isNull(), HOT_SHARE).otherwise(F.coalesce("slices", F.lit(1)))
    slice_of = F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), slices).cast("int")
    left = docs.join(F.broadcast(hot), "digest", "left").select("id", "digest", slice_of.alias("slice"))
    right = measured.join(F.broadcast(hot), "digest", "left")
    right = right.withColumn("slice", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).drop("slices")
    joined = left.join(right, ["digest", "slice"], "left")
    zeros = [F.coalesce(m, F.lit(0).cast("long")).alias(m) for m in MEASURES]
    return joined.select("id", *zeros, F.coalesce("groups", F.lit("")).alias("groups_sha256"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id and the measures of both public tokenizers on every whole text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
