"""Token counts of flat token files by separator scan.

A flat token file is a run of little-endian unsigned 16-bit ids; every document is followed by one
end-of-document id, and nothing says where documents begin. The scan cuts each file into blocks and
searches every block for the separator with one vectorised comparison. A document may begin in any
earlier block, so per block only the last separator and the number of separators are kept, and a
prefix scan over these (a running maximum and a running sum per file, in Spark) gives every block
the position and number its first document starts from.

``write_token_files`` makes such files from texts with Spark's own writer: id 0 is the separator
and ids of the vocabulary are shifted by one. A file holds at most ``FILE_DOCUMENTS`` documents.

Edge cases: NULL and empty texts are documents of 0 tokens; ids after a file's last separator are
reported as one unfinished document; empty files and tables give no rows; repeated rows are
repeated documents; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prequenta.llm.common import table
from prequenta.session import shared_folder

SEPARATOR = 0
BLOCK_IDS = 1 << 18
FILE_DOCUMENTS = 4_000
WIDTH = 2  # bytes of an id


def vocabulary_file() -> str:
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, text: str = "text") -> None:
    """Encode every text and write the flat token files below ``folder``."""
    path = path or vocabulary_file()

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(path)
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                texts = batch.column(0).slice(start, 256).to_pylist()
                ids = [(np.array(bpe.encode_ordinary(t or ""), np.int64) + 1).astype("<u2").tobytes() for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    # The writer puts the separator after every row; the bytes of a row are written as they are.
    (
        docs.select(F.col(text))
        .mapInArrow(encoded, "ids binary")
        .select(F.col("ids").cast("string"))
        .write.option("lineSep", "\0" * WIDTH)
        .option("maxRecordsPerFile", FILE_DOCUMENTS)
        .text(folder)
    )


def scan_token_files(spark: SparkSession, folder: str, separator: int = SEPARATOR, block_ids: int = BLOCK_IDS) -> DataFrame:
    """(file, document, start, n_tokens, finished): documents of each file in order, counted from 0; start in ids."""

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column("content")[i].as_buffer(), "<u2")
                file = batch.column("path")[i].as_py()
                for block, start in enumerate(range(0, len(ids), block_ids)):
                    here = ids[start : start + block_ids]
                    ends = np.flatnonzero(here == separator) + start
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([file]),
                            pa.array([block], pa.int64()),
                            pa.array([ends.tolist()], pa.list_(pa.int64())),
                            pa.array([start + len(here)], pa.int64()),
                            pa.array([start + len(here) == len(ids)]),
                        ],
                        ["file", "block", "ends", "upto", "last"],
                    )

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "content")
    blocks = files.mapInArrow(searched, "file string, block long, ends array<long>, upto long, last boolean")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = blocks.withColumns(
        {
            "_from": F.coalesce(F.max(F.array_max("ends")).over(before), F.lit(-1)) + 1,
            "_number": F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)),
        }
    )
    # What is left open at the end of a file counts as a document of its own.
    open_start = F.coalesce(F.try_element_at("ends", F.lit(-1)) + 1, F.col("_from"))
    scanned = scanned.withColumn(
        "_ends",
        F.when(F.col("last") & (open_start < F.col("upto")), F.concat("ends", F.array("upto"))).otherwise(F.col("ends")),
    )
    starts = F.concat(F.array("_from"), F.transform("_ends", lambda e: e + 1))
    return scanned.select(
        "file", "_number", F.posexplode(F.arrays_zip(F.slice(starts, 1, F.size("_ends")).alias("s"), F.col("_ends").alias("e"))), F.size("ends").alias("_n")
    ).select(
        "file",
        (F.col("_number") + F.col("pos")).alias("document"),
        F.col("col.s").alias("start"),
        (F.col("col.e") - F.col("col.s")).alias("n_tokens"),
        (F.col("pos") < F.col("_n")).alias("finished"),
    )


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens of every document, from token files that are written first and then scanned."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark, "token-files")
    write_token_files(docs.select("text"), folder)
    counts = scan_token_files(spark, folder)
    # A writing task makes the files part-<task>-...-c<nnn> in the order of its rows.
    part = F.regexp_extract("file", r"part-(\d+)-", 1).cast("long")
    nth = F.regexp_extract("file", r"-c(\d+)\.[a-z]+$", 1).cast("long")
    placed = counts.select(part.alias("part"), (nth * FILE_DOCUMENTS + F.col("document")).alias("row"), "n_tokens")
    place = F.monotonically_increasing_id()
    ids = docs.select("doc_id", place.alias("_p")).select(
        "doc_id", F.shiftright("_p", 33).alias("part"), F.col("_p").bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), F.lit(True).alias("_known")
    )
    joined = placed.join(ids, ["part", "row"], "full")
    sure = F.when(F.col("_known") & F.col("n_tokens").isNotNull(), F.col("n_tokens")).otherwise(
        F.raise_error("the token files do not follow the rows of the table")
    )
    return joined.select("doc_id", sure.alias("n_tokens"))
