"""BPE encoding and decoding with a transducer lexicon of frequent pieces.

The tokenizer cuts a text at white space into words, and words into pieces (a run of letters, a
digit, a run of signs). The ``LEXICON_PIECES`` most frequent pieces, counted over all texts, are
compiled with their ids into a minimal acyclic transducer. Its size is bounded by that parameter,
so it is broadcast; every Python worker memory-maps it. Pieces it does not hold are merged exactly: by
a library that joins by the rank of the token, where the merges are such that this is the same (see
``WordBpe.ranked``), else pair by pair. Pieces met before are taken from a bounded memo, which a worker
keeps from task to task.

Texts are cut at white space by Arrow, and each different word of a slice of texts is cut and looked up
once; its ids are then put in all its places at once. Words without characters beyond U+017F, on which
no versions of Unicode differ, are cut by the pattern here; others with the library's own tables.
Texts with such characters are split into words here, and so are those with special tokens, which match
anywhere and are cut out first.

The lexicon only saves work: ids are the same whatever it holds.

Edge cases: a NULL text counts as empty and has no ids, and decodes to the empty text; repeated
rows are all reported; an empty table gives an empty result; ``encode_decode`` leaves all other
columns as they are.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain, pairwise

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from prequenta.llm.common import drop_written, kept, table, written
from prequenta.llm.lexicon import Lexicon, compile_lexicon

LEXICON_PIECES = 100_000
SAMPLE_TEXTS = None  # no sample is taken any more; the name stays for code that still sets it
MAX_PIECE = 64  # bytes; longer pieces are not worth a place in the lexicon
MEMO_WORDS = 150_000  # pieces in each of two generations, and from which on counts are sent off
SLICE_BYTES = 4 << 20  # of texts whose words are looked up together
#: Letters, numbers and white space up to U+017F as classes of the split pattern.
CLASSES = {r"\p{L}": "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u017f", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r \x85\xa0"}
NO_RANKS: dict[int, int] = {}  # of an id that begins no pair
PIECE_END = "\n"  # white space, which no piece holds


def tokenizer_file() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 stays, the rest follows from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """Encoder for tokenizer files of this kind: NFC, lower case, a split pattern, byte letters, word ends."""

    def __init__(self, path: str, lexicon: bytes | None = None):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.library = Tokenizer.from_file(path)
        self.specials: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        token = {i: t for t, i in (self.vocab | self.specials).items()}
        self.token = [token.get(i, "") for i in range(max(token) + 1)]
        # By left id: right id -> rank of the pair; by rank: id of the joined token.
        self.ranks: list[dict[int, int]] = [NO_RANKS] * len(self.token)
        self.made: list[int] = []
        self.pairs = [(self.vocab[left], self.vocab[right]) for left, right in model["merges"]]
        for rank, (left, right) in enumerate(self.pairs):
            if self.ranks[left] is NO_RANKS:
                self.ranks[left] = {}
            self.ranks[left].setdefault(right, rank)
            self.made.append(self.vocab["".join(model["merges"][rank])])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        for name, chars in CLASSES.items():
            pattern = pattern.replace(name, chars)
        self.early_pieces = re.compile(pattern).findall
        letters = _byte_letters()
        self.byte_of = {letter: byte for byte, letter in enumerate(letters)}
        self.inner = [self.vocab[x] for x in letters]
        self.last = [self.vocab[x + self.end] for x in letters]
        self.cut = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")").split
        # Texts that are cut into words here and not by Arrow: special tokens, what splits words in Arrow only, late letters.
        self.odd = "|".join([r"[\x1c-\x1f]", r"[^\x00-\x{17f}]", *map(re.escape, self.specials)])
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.parts = Memo(lambda piece: array("i", self.merged(piece)).tobytes())
        # What is joined by blanks: of all texts of a slice together it may take more than 2 GB.
        self.numbers = pa.array([str(i) for i in range(len(self.token))], pa.large_string())
        self.tokens = pa.array(self.token, pa.large_string())

    def merged(self, piece: bytes | str) -> list[int]:
        """Ids of one piece: from the lexicon, or joining the pair of lowest rank, leftmost first, until none is left."""
        if isinstance(piece, str):
            piece = piece.encode("utf-8")
        if self.lexicon is not None and len(piece) <= MAX_PIECE:
            got = self.lexicon.get(piece)
            if got is not None:
                return got
        if self.ranked is None:
            return self.joined(piece)
        ids = self.of_rank
        return [ids[r] for r in self.ranked(piece.decode("utf-8") + PIECE_END)]

    def joined(self, piece: bytes, whole: bool = True) -> list[int]:
        """The same without lexicon and library; ``whole`` if a word ends with the piece."""
        ids = [self.inner[b] for b in piece]
        if whole:
            ids[-1] = self.last[piece[-1]]
        ranks, made = self.ranks, self.made
        none = len(made)
        todo = [ranks[left].get(right, none) for left, right in pairwise(ids)]
        while todo and (best := min(todo)) < none:
            at = todo.index(best)
            new = ids[at] = made[best]
            del ids[at + 1], todo[at]
            if at:
                todo[at - 1] = ranks[ids[at - 1]].get(new, none)
            if at < len(todo):
                todo[at] = ranks[new].get(ids[at + 1], none)
        return ids

    @cached_property
    def ranked(self):
        """Ranks of the tokens of a piece with ``PIECE_END`` (``of_rank``: their ids), joined by a library that
        knows the rank of a token, not the pair it is made of; None if that may give other ids.

        It gives the same ones if parts come before what is made of them, no token is made twice and each token,
        as a piece, is joined to itself. Until the two differ, pairs are joined by rising rank; if the library then
        joins a and b to a token made of another pair, the token as a piece of its own also gets to a and b with
        all lower ranks used up, and would not be joined to itself.
        """
        end = PIECE_END.encode()
        spelt = {i: bytes([b]) for b, i in enumerate(self.inner)} | {i: bytes([b]) + end for b, i in enumerate(self.last)}
        for left, right in self.pairs:
            made = self.made[len(spelt) - 512]
            if left not in spelt or right not in spelt or made in spelt:
                return None
            spelt[made] = spelt[left] + spelt[right]
        self.of_rank = list(spelt)
        for i, piece in spelt.items():
            if piece != end and self.joined(piece.removesuffix(end), piece.endswith(end)) != [i]:
                return None
        # The first ranks are single bytes, then those that end a piece, which are joined before anything else.
        ranks = {x: r for r, x in enumerate(spelt.values())}
        if len(ranks) < len(spelt):
            return None
        return tiktoken.Encoding("ranks", pat_str=f"[^{PIECE_END}]*{PIECE_END}", mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def cut_word(self, word: str) -> list[str] | list[bytes]:
        """Pieces of a word without white space or special tokens, normalised, as bytes if they were cut by the library."""
        if word.isascii():
            low = word.lower()
            return [low] if low.isalpha() else self.early_pieces(low)
        if max(word) < "\u0180":
            return self.early_pieces(word.lower())
        # Letters on which versions of Unicode differ: cut by the library's own tables.
        normal = self.library.normalizer.normalize_str(word)
        return [bytes([self.byte_of[c] for c in p]) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def encoded(self, word: str) -> bytes:
        """Ids, four bytes each, of a word without white space, or of a special token."""
        if word in self.specials:
            return array("i", [self.specials[word]]).tobytes()
        cut, parts = self.cut_word(word), self.parts
        return parts[cut[0]] if len(cut) == 1 else b"".join([parts[piece] for piece in cut])

    def word_lists(self, texts: pa.Array) -> pa.ListArray:
        """The words and special tokens of each text; a NULL text has none. Empty words are among them."""
        texts = texts.fill_null("")
        odd = pc.match_substring_regex(texts, self.odd)
        lists = pc.utf8_split_whitespace(texts.filter(pc.invert(odd)))
        if len(lists) == len(texts):
            return lists
        rest = [[w for i, span in enumerate(self.cut(t)) for w in ([span] if i % 2 else split_words(span))] for t in texts.filter(odd).to_pylist()]
        at = odd.to_numpy(zero_copy_only=False)
        order = np.argsort(np.concatenate([np.flatnonzero(~at), np.flatnonzero(at)]))
        return pa.concat_arrays([lists, pa.array(rest, lists.type)]).take(pa.array(order))

    def texts(self, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
        """For each text the number of ids, the ids as text and the decoded text. Each different word is looked up once."""
        lists = self.word_lists(texts)
        words = lists.flatten().dictionary_encode()
        found = [self.encoded(w) for w in strings(words.dictionary)]
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        of_words = np.frombuffer(b"".join(found), np.int32)
        at = words.indices.to_numpy()
        n = sizes[at]
        upto = np.concatenate([[0], n.cumsum()])
        # The place of each id in of_words: where its word's ids start there, and how many of the word's ids come before it.
        places = np.repeat((sizes.cumsum() - sizes)[at] - upto[:-1], n) + np.arange(upto[-1])
        ids = pa.array(of_words[places])
        ends = upto[np.concatenate([[0], pc.list_value_length(lists).to_numpy().cumsum()])]

        def joined(names: pa.Array) -> pa.Array:
            return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), names.take(ids)), pa.scalar(" ", names.type))

        return pa.array(np.diff(ends), pa.int64()), joined(self.numbers), joined(self.tokens)

    def text(self, text: str) -> tuple[int, bytes, bytes]:
        """(number of ids, ids as text, decoded text)."""
        n, ids, decoded = (x[0].as_py() for x in self.texts(pa.array([text], pa.string())))
        return n, ids.encode(), decoded.encode()


class Memo(dict):
    """What was found for pieces, in two generations: the older one goes when the newer one is full."""

    def __init__(self, find):
        super().__init__()
        self.find, self.old = find, {}

    def __missing__(self, piece: str | bytes):
        if len(self) >= MEMO_WORDS:
            self.old = dict(self)
            self.clear()
        got = self.old.get(piece)
        if got is None:
            got = self.find(piece)
        self[piece] = got
        return got


# White space of the tokenizer's patterns; Python's str.split() also breaks at U+001C to U+001F, which are none there.
_SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
_ODD = re.compile("[\\x1c-\\x1f]")


def split_words(text: str) -> list[str]:
    return [w for w in _SPACE.split(text) if w] if _ODD.search(text) else text.split()


def slices(batch: pa.RecordBatch, texts: pa.Array) -> Iterator[pa.RecordBatch]:
    """The rows of the batch, about ``SLICE_BYTES`` of the texts at once; a longer text alone or with some before it."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
    cuts = np.flatnonzero(np.diff(upto // SLICE_BYTES)) + 1
    for start, end in pairwise([0, *cuts.tolist(), batch.num_rows]):
        yield batch.slice(start, end - start)


def strings(column: pa.Array) -> list[str]:
    """As ``to_pylist``, several times faster."""
    return column.to_numpy(zero_copy_only=False).tolist()


def frequent_pieces(docs: DataFrame, path: str, n: int = LEXICON_PIECES, text: str = "text") -> DataFrame:
    """(piece) of at most n rows: the pieces that occur more often in all texts than the others do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path, "", None)
        counts: Counter[str | bytes] = Counter()

        def flush() -> pa.RecordBatch:
            pieces = [(p if isinstance(p, bytes) else p.encode(), times) for p, times in counts.items()]
            counts.clear()
            pieces = [x for x in pieces if len(x[0]) <= MAX_PIECE]
            return pa.RecordBatch.from_arrays([pa.array([x[0] for x in pieces], pa.binary()), pa.array([x[1] for x in pieces], pa.int64())], ["piece", "n"])

        for batch in chain.from_iterable(slices(b, b.column(0)) for b in batches):
            words = pc.value_counts(bpe.word_lists(batch.column(0)).flatten())
            for word, times in zip(strings(words.field("values")), words.field("counts").to_numpy().tolist(), strict=True):
                for piece in () if word in bpe.specials else bpe.cut_word(word):  # each different word is cut once
                    counts[piece] += times
            if len(counts) > MEMO_WORDS:
                yield flush()
        yield flush()

    counted = docs.select(F.col(text)).mapInArrow(count, "piece binary, n long").groupBy("piece").agg(F.sum("n").alias("n"))
    counted = written(counted, "bpe-pieces")
    # From how many pieces have counts of the same 64th of a factor of two (64 * 63 rows at most): the least whose pieces all have a place.
    level = F.floor(F.log2("n") * 64)
    limit, places = None, n
    for row in counted.groupBy(level.alias("level")).agg(F.count("*").alias("pieces")).orderBy(F.desc("level")).collect():
        places -= row["pieces"]
        if places < 0:
            break
        limit = row["level"]
    return counted.where(F.lit(False) if limit is None else level >= limit)


def build_lexicon(docs: DataFrame, path: str, n: int = LEXICON_PIECES, text: str = "text") -> bytes:
    """The compiled lexicon: put together by one task from at most n pieces, only its bytes come to the driver."""

    def compiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path, "", None)
        pieces = [p for batch in batches for p in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([compile_lexicon((p, bpe.merged(p)) for p in pieces)], pa.binary())], ["data"])

    pieces = frequent_pieces(docs, path, n, text)
    found = pieces.select("piece").repartition(1).mapInArrow(compiled, "data binary").collect()
    drop_written(pieces)
    return bytes(found[0]["data"]) if found else compile_lexicon([])


def worker_bpe(path: str, digest: str, lexicon) -> WordBpe:
    """The encoder of a Python worker, kept with its memos from task to task; the digest tells (broadcast) lexicons apart."""
    return kept((path, digest), lambda: WordBpe(path, lexicon.value if lexicon else None))


def encode_decode(docs: DataFrame, path: str | None = None, lexicon: bytes | None = None, text: str = "text") -> DataFrame:
    """docs with ``n_tokens``, ``ids`` (decimal, one space between) and ``decoded``, in place of equally named columns."""
    path = path or tokenizer_file()
    if lexicon is None:
        lexicon = build_lexicon(docs, path, text=text)
    return _mapped(docs, path, lexicon, text, ["n_tokens long", "ids string", "decoded string"], lambda texts: texts.cast(pa.string()))


def _hashed(texts: pa.Array) -> pa.Array:
    return pa.array([hashlib.sha256(x).hexdigest() for x in texts.cast(pa.large_binary()).to_pylist()], pa.string())


def encode_digests(docs: DataFrame, path: str | None = None, lexicon: bytes | None = None, text: str = "text") -> DataFrame:
    """docs with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``: as ``encode_decode``, but only digests leave the worker."""
    path = path or tokenizer_file()
    if lexicon is None:
        lexicon = build_lexicon(docs, path, text=text)
    return _mapped(docs, path, lexicon, text, ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"], _hashed)


def _mapped(docs: DataFrame, path: str, lexicon: bytes, text: str, outputs: list[str], form) -> DataFrame:
    names = [o.split()[0] for o in outputs]
    keep = [c for c in docs.columns if c not in names]
    schema = T.StructType([f for f in docs.schema.fields if f.name in keep] + list(T.StructType.fromDDL(", ".join(outputs)).fields))
    shared, digest = docs.sparkSession.sparkContext.broadcast(lexicon), hashlib.sha256(lexicon).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = worker_bpe(path, digest, shared)
        for batch in chain.from_iterable(slices(b, b.column(text)) for b in batches):
            n, ids, decoded = bpe.texts(batch.column(text))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), n, form(ids), form(decoded)], keep + names)

    return docs.select(*keep).mapInArrow(run, schema)


def op7_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_digests(docs).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
