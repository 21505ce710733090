"""Two tokenizers aligned, against a plain version over all texts."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from prequenta.llm import crosstoken
from prequenta.llm.common import table

FILES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """Texts by key to the measures of the contract, with loops and dictionaries only."""
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    entry, alphabet = {i: e for e, i in a.get_vocab().items()}, crosstoken.byte_alphabet()

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def one(text):
        if not text:
            return None
        ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts_a, parts_b = [bytes(alphabet[c] for c in entry[i]) for i in ids_a], [b_bytes(i) for i in ids_b]
        whole = (" " + text).encode()
        if b"".join(parts_a) != whole or b"".join(parts_b) != whole:
            return None
        ends = []
        for parts in (parts_a, parts_b):
            upto, at = 0, {}
            for k, part in enumerate(parts):
                upto += len(part)
                at[upto] = k
            ends.append(at)
        groups, links, i, j = [], [], 0, 0
        for cut in sorted(set(ends[0]) & set(ends[1])):
            x, y = ends[0][cut] + 1, ends[1][cut] + 1
            groups.append(",".join(map(str, ids_a[i:x])) + "|" + ",".join(map(str, ids_b[j:y])))
            links.append((ids_a[x - 1], ids_b[y - 1]))
            i, j = x, y
        return len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()

    def all_of(rows):
        found = [(key, one(text)) for key, text in rows]
        counts = Counter(link for _, f in found if f for link in f[3])
        best = Counter()
        for (_, y), c in counts.items():
            best[y] = max(best[y], c)
        zero = (0, 0, 0, 0, 0, 0, "")
        return sorted(
            (key, *(zero if f is None else (*f[:3], len(f[3]), sum(counts[x] == best[x[1]] for x in f[3]), sum(counts[x] for x in f[3]), f[4])))
            for key, f in found
        )

    return all_of


def test_alignment_equals_brute_force(spark, sf_dir, plain):
    docs = [(r["doc_id"], r["text"]) for r in table(spark, sf_dir, "documents").collect()]
    assert sorted(tuple(r) for r in crosstoken.op11_token_alignment(spark, sf_dir).collect()) == plain(docs)


def test_alignment_of_odd_and_repeated_texts(spark, plain, monkeypatch):
    """Copies in many slices, texts that a tokenizer changes, special tokens as text, blocks of one text."""
    monkeypatch.setattr(crosstoken, "HOT_SHARE", 4)
    monkeypatch.setattr(crosstoken, "BLOCK_BYTES", 100)
    texts = ["one text of many copies"] * 40 + [None, "", " ", "\n\t x", "a ▁ b", "<|endoftext|> and </s><s>", "é ß 中文 \U0001f600 ﬁ ①", "x" * 5000, "one text"]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    frame = spark.createDataFrame([(i, t, i) for i, t in rows], "doc_id long, text string, digest int")
    got = crosstoken.align(frame, *FILES)
    assert sorted(tuple(r) for r in got.collect()) == plain(rows)
    assert got.columns == ["doc_id", *crosstoken.MEASURES, "groups_sha256"]


def test_alignment_of_no_rows_and_of_rows_without_ids(spark, odd_docs, no_docs):
    assert crosstoken.align(no_docs, *FILES).count() == 0
    got = crosstoken.align(odd_docs, *FILES)
    assert got.count() == odd_docs.count() and got.where("doc_id IS NULL AND n_a > 0").count() == 1
    assert crosstoken.align(odd_docs.where(F.col("text").isNull()), *FILES).first()["groups_sha256"] == ""


def test_ids_of_a_are_those_of_its_library():
    """Random texts around the border up to which ranks are used, and long words on both sides of the length."""
    both = crosstoken.Tokenizers(*FILES)
    rng = np.random.default_rng(3)
    early = [chr(c) for c in range(1, 0x180)] + [" ", "\n", "'s", "'ll", "the", "12"] * 20
    texts = ["".join(rng.choice(early, int(rng.integers(1, 80))).tolist()) for _ in range(1500)]
    texts += ["x" * 99_000, "x" * 100_000, " " * 3000 + "a", "<|endoftext|>", "\u0180 \u2019 \u4e2d", "ab" * 3000 + "\x1c\x85\xa0"]
    for t in texts:
        assert both.ids_of_a(t) == both.a.encode(t, add_special_tokens=False).ids, repr(t[:80])


def test_each_text_is_aligned_once(spark, monkeypatch):
    frame = spark.createDataFrame([(i, f"text {i % 3}") for i in range(300)], "doc_id long, text string")
    blocks = []
    monkeypatch.setattr(crosstoken, "pair_counts", lambda b, f=crosstoken.pair_counts: (blocks.append(b), f(b))[1])
    assert crosstoken.align(frame, *FILES).where("n_a > 0").count() == 300
    assert blocks[0].agg(F.sum(F.size("texts"))).first()[0] == 3
