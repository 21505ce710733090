"""Benchmark decontamination by templates.

Texts are reduced to templates: words in lower case, numbers, names (capitalised words that do not
open a sentence, runs of them as one) and units behind a number replaced by typed placeholders.
Windows of ``WINDOW`` template tokens of all benchmark items (a whole item if it is shorter) are
hashed; a bitmap of fixed maximal size picks the windows of the documents that may be among them,
and a hash join with the benchmark's windows decides. All occurrences in a document count, with their
places. From every place where the item may begin, its windows are matched with the nearest
occurrences, within several distances (none, one window, the item's length, the whole document). A
(document, item) pair is reported if in one of these alignments

* at least ``MIN_COVERAGE`` of the item's different windows are met, and
* the slots are filled consistently: where the item has one value, the document has one value
  throughout (``MIN_CONSISTENCY`` of the slot occurrences agree with the commonest filling).

The figures are those of the alignment with most windows, and then the highest consistency.

So a question with other numbers or names is found, and texts that merely share a form are not.
Windows with less than ``MIN_LITERALS`` words are too general to count.

Items of at most ``SHORT`` tokens have no window to spare, and where they are mostly numbers and names
none that counts. They are besides matched literally, as a whole: words in lower case and numbers as they
stand, signs aside. An item of less than ``MIN_LITERALS`` tokens only matches a document that holds
nothing else.

Edge cases: NULL or empty texts and items without words match nothing; repeated rows of an id count
as one document; equal items are all reported; an empty table on either side gives an empty result;
other columns are ignored (and pass through ``decontaminated``).
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prequenta.llm.common import table, written

WINDOW = 8
MIN_LITERALS = 3
SHORT = WINDOW + 1
LITERAL = np.uint64(0x5DEECE66D1CE4E5B)  # tells hashes of literal windows from others
MIN_COVERAGE = 0.6
MIN_CONSISTENCY = 0.9
MAX_BITS = 28  # of the bitmap: 32 MB
MEMO_WORDS = 300_000

UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg gram grams kilogram kilograms pound pounds ounce ounces lb lbs oz ml "
    "l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months "
    "year years percent degree degrees celsius fahrenheit dollar dollars cent cents euro euros usd eur watt watts volt volts".split()
)
# Sentence ends, letters, numbers; everything else separates.
TOKEN = re.compile(r"[.!?:;]\s|\n|[^\W\d_]+|\d+(?:[.,]\d+)*").findall
BREAK, NUMBER, NAME, UNIT, DOCUMENT = range(1, 6)
CAPITAL, UNIT_WORD = 1, 2


class Tokens(dict):
    """Token -> (code, flags) packed as code * 4 + flags; codes of words are hashes."""

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        first = token[0]
        if first.isalpha():
            low = token.lower()
            flags = CAPITAL * (first.isupper() and (token[1:].islower() and len(token) > 1)) | UNIT_WORD * (low in UNITS)
            code = (xxhash.xxh3_64_intdigest(low) >> 4) | 8  # below 2**60 and none of the special codes
        else:
            code, flags = (NUMBER if first.isdigit() else BREAK), 0
        self[token] = value = code * 4 + flags
        return value


def templates(texts: list[str | None], memo: Tokens) -> tuple[np.ndarray, np.ndarray, list[str], np.ndarray]:
    """Template codes of all texts in a row, each text followed by DOCUMENT.

    Also per code the index of its first token (the end is the next code's), the tokens, and the
    number of the text.
    """
    tokens: list[str] = []
    sizes = []
    for text in texts:
        found = TOKEN(text or "")
        tokens += found
        tokens.append("\n")
        sizes.append(len(found) + 1)
    packed = np.fromiter(map(memo.__getitem__, tokens), np.int64, len(tokens))
    code, flags = packed >> 2, packed & 3
    owner = np.repeat(np.arange(len(texts)), sizes)
    code[np.cumsum(sizes) - 1] = DOCUMENT
    before = np.empty_like(code)
    before[:1], before[1:] = DOCUMENT, code[:-1]
    opens = (before == BREAK) | (before == DOCUMENT)
    code[((flags & UNIT_WORD) > 0) & (before == NUMBER)] = UNIT
    name = ((flags & CAPITAL) > 0) & ~opens & (code != UNIT)
    code[name] = NAME
    run = np.zeros(len(code), bool)
    run[1:] = name[1:] & name[:-1]
    keep = (code != BREAK) & ~run
    at = np.flatnonzero(keep)
    return code[at], at, tokens, owner[at]


class Literals(dict):
    """Token -> code of the token as it stands, in lower case; 0 for breaks."""

    def __missing__(self, token: str) -> int:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[token] = value = (xxhash.xxh3_64_intdigest(token.lower()) >> 4) | 8 if token[0].isalnum() else 0
        return value


def literals(texts: list[str | None], memo: Literals) -> tuple[np.ndarray, np.ndarray]:
    """Literal codes of all texts in a row, each text followed by DOCUMENT, and the number of the text per code."""
    found = [[memo[t] for t in TOKEN(text or "")] + [DOCUMENT] for text in texts]
    owner = np.repeat(np.arange(len(texts)), [len(f) for f in found])
    code = np.array([c for f in found for c in f], np.int64)
    return code[code > 0], owner[code > 0]


def literal_matches(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the literal windows of ``size`` tokens, and where they begin; short ones only where they are a whole text."""
    value, words = hashes(code, size)
    whole = words == size
    if size < MIN_LITERALS and len(whole):
        opens, closes = np.ones(len(whole), bool), np.zeros(len(whole), bool)
        opens[1:] = code[: len(whole) - 1] == DOCUMENT
        closes[: len(code) - size] = code[size:] == DOCUMENT
        whole &= opens & closes
    at = np.flatnonzero(whole)
    return value[at] ^ LITERAL, at


def hashes(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and number of words of each window of ``size`` codes; windows over a text's end have -1 words."""
    n = len(code) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    mixed = code.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(31)
    out = np.full(n, size, np.uint64)
    for i in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + mixed[i : i + n]
    out ^= out >> np.uint64(32)
    ends = np.concatenate([[0], np.cumsum(code == DOCUMENT)])
    words = np.concatenate([[0], np.cumsum(code > DOCUMENT)])
    count = words[size:] - words[:-size]
    count[(ends[size:] - ends[:-size]) > 0] = -1
    return out, count


def _slots(code: np.ndarray, at: np.ndarray, tokens: list[str], i: int, size: int) -> list[str]:
    """Fillings of the placeholders of a window, in order."""
    out = []
    for j in range(i, i + size):
        if code[j] <= UNIT:
            end = at[j + 1] if code[j] == NAME and j + 1 < len(at) else at[j] + 1
            out.append(" ".join(t for t in tokens[at[j] : end] if t[0].isalpha() or t[0].isdigit()))
    return out


LEAKS = "doc_id long, item_id long, n_windows long, n_matched long, coverage double, consistency double"
WINDOWS = "id long, hash long, place int, slots array<string>"


def alignment(
    asked: list[tuple[int, int, list[str]]], met: list[tuple[int, int, list[str]]], min_coverage: float, min_consistency: float
) -> tuple[int, float] | None:
    """(different windows met, consistency) of the best alignment of an item's windows with a document's; None if none will do.

    Both lists have (hash, place, slots).
    """
    places: dict[int, dict[int, list[str]]] = defaultdict(dict)
    for value, place, slots in met:
        places[value][place] = slots
    order = {value: sorted(found) for value, found in places.items()}
    wanted = [(value, at, slots) for value, at, slots in asked if value in places]
    least = min_coverage * len({value for value, _, _ in asked})
    length = max(at for _, at, _ in asked) + WINDOW
    best = None
    done = set()
    for start in sorted({place - at for value, at, _ in wanted for place in order[value]}):
        near = []
        for value, at, slots in wanted:
            found = order[value]
            i = bisect_left(found, start + at)
            place = min(found[max(0, i - 1) : i + 1], key=lambda p: (abs(p - start - at), p))
            near.append((abs(place - start - at), value, place, slots, places[value][place]))
        for reach in (0, WINDOW, length, None):
            used = [x for x in near if reach is None or x[0] <= reach]
            n = len({x[1] for x in used})
            key = tuple(x[2] if reach is None or x[0] <= reach else -1 for x in near)
            if n < least or key in done or (best and (n, 1.0) <= best):
                continue
            done.add(key)
            fillings: dict[str, Counter[str]] = defaultdict(Counter)
            for _, _, _, mine, theirs in used:
                if len(mine) == len(theirs):
                    for a, g in zip(mine, theirs, strict=True):
                        fillings[a][g] += 1
            total = sum(c.total() for c in fillings.values())
            consistency = sum(max(c.values()) for c in fillings.values()) / total if total else 1.0
            if consistency >= min_consistency and (best is None or (n, consistency) > best):
                best = (n, consistency)
    return best


def _items(items: DataFrame, window: int) -> DataFrame:
    """(item, size, hash, place, slots) of the windows of each item; the literal window of a short item has minus its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, plain = Tokens(), Literals()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                code, _ = literals([text], plain)
                if 1 < len(code) <= SHORT + 1:
                    value, _ = literal_matches(code, len(code) - 1)
                    rows.append((item, 1 - len(code), value[0], 0, []))
                code, at, tokens, _ = templates([text], memo)
                size = min(window, len(code) - 1)
                if size < MIN_LITERALS:
                    continue
                for i, (value, words) in enumerate(zip(*hashes(code, size), strict=True)):
                    if words >= MIN_LITERALS:
                        rows.append((item, size, value, i, _slots(code, at, tokens, i, size)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(columns[0], pa.int64()),
                    pa.array(columns[1], pa.int32()),
                    pa.array(np.array(columns[2], np.uint64).view(np.int64)),
                    pa.array(columns[3], pa.int32()),
                    pa.array(columns[4], pa.list_(pa.string())),
                ],
                ["item", "size", "hash", "place", "slots"],
            )

    return items.mapInArrow(run, "item long, size int, hash long, place int, slots array<string>")


def _bitmap(windows: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the window hashes, packed; built from partial bitmaps, so hashes are not collected."""
    n = windows.count()
    bits = int(min(MAX_BITS, max(16, np.ceil(np.log2(n * 32 + 1)))))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            seen.update((batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(sorted(seen), pa.int64())], ["bit"])

    out = np.zeros(1 << bits, bool)
    for row in windows.select("hash").mapInArrow(partial, "bit long").distinct().toLocalIterator():
        out[row["bit"]] = True
    return np.packbits(out), bits


def leaks(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    min_coverage: float = MIN_COVERAGE,
    min_consistency: float = MIN_CONSISTENCY,
    text: str = "text",
) -> DataFrame:
    """(doc_id, item_id, n_windows, n_matched, coverage, consistency) of the contaminated pairs."""
    spark = docs.sparkSession
    windows = _items(items.select(F.col("item_id").cast("long"), F.col("text")), window).persist()
    every = sorted(r["size"] for r in windows.select("size").distinct().collect())  # WINDOW + SHORT at most
    sizes, short = [s for s in every if s > 0], [-s for s in every if s < 0]
    packed, bits = _bitmap(windows)
    shared = spark.sparkContext.broadcast(packed)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, plain, map_ = Tokens(), Literals(), shared.value
        shift = np.uint64(64 - bits)

        def hits(value: np.ndarray) -> np.ndarray:
            bit = (value >> shift).astype(np.int64)
            return ((map_[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1) > 0

        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                ids = batch.column(0).slice(start, 128).to_pylist()
                code, at, tokens, owner = templates(batch.column(1).slice(start, 128).to_pylist(), memo)
                rows: list[tuple[int, int, int, list[str]]] = []
                first = np.searchsorted(owner, np.arange(len(ids)))
                for size in sizes:
                    value, words = hashes(code, size)
                    for i in np.flatnonzero(hits(value) & (words >= MIN_LITERALS)):
                        rows.append((ids[owner[i]], int(value[i]), int(i - first[owner[i]]), _slots(code, at, tokens, i, size)))
                if short:
                    code, owner = literals(batch.column(1).slice(start, 128).to_pylist(), plain)
                    for size in short:
                        value, at = literal_matches(code, size)
                        for i in np.flatnonzero(hits(value)):
                            rows.append((ids[owner[at[i]]], int(value[i]), -1, []))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([r[0] for r in rows], pa.int64()),
                        pa.array(np.array([r[1] for r in rows], np.uint64).view(np.int64)),
                        pa.array([r[2] for r in rows], pa.int32()),
                        pa.array([r[3] for r in rows], pa.list_(pa.string())),
                    ],
                    ["id", "hash", "place", "slots"],
                )

    texts = docs.select(F.col("doc_id").cast("long"), F.col(text)).where("doc_id IS NOT NULL")
    found = written(texts.mapInArrow(search, WINDOWS), "leaks-found")
    whole, windows = windows.where("size < 0"), windows.where("size > 0")
    total = windows.groupBy("item").agg(F.countDistinct("hash").alias("n_windows"))
    # Repeated rows of an id count as one document.
    met = found.where("place >= 0").join(windows.select("item", "hash").distinct(), "hash").select("id", "item", "hash", "place", "slots").distinct()
    covered = (
        met.groupBy("id", "item")
        .agg(F.countDistinct("hash").alias("n"), F.collect_list(F.struct("hash", "place", "slots")).alias("met"))
        .join(total, "item")
        .where(F.col("n") >= min_coverage * F.col("n_windows"))
    )
    asked = windows.groupBy("item").agg(F.sort_array(F.collect_set(F.struct("hash", "place", "slots"))).alias("asked"))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, item, n, met, asked in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                listed = [[(x["hash"], x["place"], x["slots"]) for x in xs] for xs in (asked, sorted(met, key=lambda x: (x["place"], x["slots"])))]
                best = alignment(*listed, min_coverage, min_consistency)
                if best:
                    rows.append((id_, item, n, best[0], best[0] / n, best[1]))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], LEAKS.replace(",", "").split()[::2])

    aligned = covered.join(asked, "item").select("id", "item", "n_windows", "met", "asked").mapInArrow(align, LEAKS)
    if not short:
        return aligned
    # A literal copy counts as one window that is met, unless the item's windows are met besides.
    copies = found.where("place < 0").join(whole.select("item", "hash"), "hash").select(F.col("id").alias("doc_id"), F.col("item").alias("item_id")).distinct()
    one = F.lit(1).cast("long")
    literal = copies.select("doc_id", "item_id", one.alias("n_windows"), one.alias("n_matched"), F.lit(1.0).alias("coverage"), F.lit(1.0).alias("consistency"))
    best = F.max_by(F.struct("n_windows", "n_matched", "coverage", "consistency"), F.struct("n_matched", "n_windows"))
    return aligned.unionByName(literal).groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def decontaminated(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """docs without the contaminated ones; rows without an id stay."""
    return docs.join(leaks(docs, items, text=text).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
