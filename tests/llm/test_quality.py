"""Quality rules against plain counts and a plain estimate of each group."""

import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from prequenta.llm import quality
from prequenta.llm.common import table


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    repeated = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), repeated, len(again)


def plain_fit(x):
    """The estimate over one group's places: sorted distances, and the bin at the boundary with a weight."""
    resolved = np.diag(quality.RESOLUTION**2)
    middle = np.median(x, axis=0)
    starts = [np.diag((1.4826 * np.median(abs(x - middle), axis=0)) ** 2) + resolved, resolved]
    fits = []
    for spread in starts:
        mean = middle
        for _ in range(quality.STEPS):
            y = x - mean
            d = np.einsum("ij,jk,ik->i", y, np.linalg.inv(spread), y)
            bins = np.floor(np.log2(np.maximum(d, 2.0**-20)) * quality.BINS)
            most = np.ceil(quality.SHARE * len(x))
            cut = np.sort(bins)[int(most) - 1]
            weight = np.where(bins < cut, 1.0, np.where(bins == cut, (most - (bins < cut).sum()) / (bins == cut).sum(), 0.0))
            before, mean = mean, np.average(x, axis=0, weights=weight)
            spread = quality.CONSISTENT * np.cov(x.T, bias=True, aweights=weight) + resolved
            fits.append((abs(mean - before) / quality.RESOLUTION).max())
        fits.append((np.linalg.slogdet(spread)[1], mean, spread))
    return min((f for f in fits if isinstance(f, tuple)), key=lambda f: f[0])[1:]


def test_counts_equal_plain_counts(spark, sf_dir):
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf_dir, "documents").collect()}
    rows = quality.op12_quality_rules(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        counts = plain_counts(texts[r["doc_id"]])
        assert tuple(r[c] for c in quality.COUNTS) == counts
        assert r["base_failed"] == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r["base_failed"] and r["kept"])


@pytest.mark.parametrize("text", ["", "a", "a b", "a a a a", "a b c a b c", "x\n\nx\n \n y\r\ny", "a\x85b\x1cc d #|", "p q r s p q r t q r s"])
def test_counts_of_small_texts(text):
    assert quality.counts_of(text)[:5] == plain_counts(text)


def test_distances_equal_a_plain_estimate(spark):
    """Two large groups, one of them with a quarter of odd rows, and small ones that are judged together."""
    rng = np.random.default_rng(5)
    texts = []
    for group, size in ((("en", "a"), 300), (("de", None), 120), ((None, "b"), 40), (("fr", "c"), 40)):
        for i in range(size):
            words = [rng.choice(list("abcdefghij"), int(rng.integers(2, 9))).tolist() for _ in range(int(rng.integers(55, 300)))]
            junk = "$%#" if group[1] == "a" and i % 5 == 0 else ""
            texts.append((len(texts), " ".join("".join(w) + junk for w in words), *group))
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string, source string")
    places = {r["row"]["doc_id"]: [r[f"t{i}"] for i in range(quality.P)] for r in quality.measured(docs, ("doc_id",)).collect()}
    groups = defaultdict(list)
    for i, _, lang, source in texts:
        groups[(lang, source) if source in ("a", None) else "small"].append(i)
    expected = {}
    for ids in groups.values():
        x = np.array([places[i] for i in ids], float)
        mean, spread = plain_fit(x)
        expected |= dict(zip(ids, np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(spread), x - mean), strict=True))
    rows = quality.assess(docs).collect()
    for r in rows:
        assert np.isclose(r["distance"], expected[r["doc_id"]], rtol=0.02, atol=0.02)
    junk = {i for i, t, *_ in texts if "$" in t}
    assert {r["doc_id"] for r in rows if not r["kept"]} == junk


def test_concentration_finds_the_smallest_determinant():
    """Of all subsets of a small set, none of that size has a smaller determinant than the one found."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 60, (9, quality.P)), rng.normal(3000, 60, (3, quality.P))])
    mean, _ = plain_fit(x)
    sizes = {}
    for chosen in product([0, 1], repeat=len(x)):
        if sum(chosen) == 9:
            some = x[np.array(chosen, bool)]
            sizes[chosen] = np.linalg.slogdet(np.cov(some.T, bias=True) + np.diag(quality.RESOLUTION**2))[1]
    assert np.allclose(mean, x[np.array(min(sizes, key=sizes.get), bool)].mean(axis=0))


def test_verdicts_agree_with_the_labels(spark):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in quality.op12_quality_rules(spark, sf_dir).collect()}
    labels = Counter()
    for r in table(spark, sf_dir, "labels").collect():
        row = rows[r["doc_id"]]
        labels[r["quality"], row["kept"], row["base_failed"]] += 1
    assert labels[0, True, False] == 0  # every page of junk goes
    assert labels[1, False, False] == 0  # and no other text but by the plain limits


def test_no_group_dominated_by_copies_loses_its_others(spark):
    words = "the wind went over a hill and some people saw it again from far away while others slept on".split()
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(words * 5 + [f"n{k}" for k in range(60)]), "en", "s") for i in range(200)]
    rows += [(200 + i, " ".join(rng.choice(words, 60 + 12 * i).tolist() + [f"u{i}x{k}" for k in range(200)]), "en", "s") for i in range(40)]
    got = quality.assess(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).where("NOT base_failed AND NOT kept")
    assert got.count() == 0


def test_odd_rows(spark, odd_docs, no_docs):
    docs = odd_docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("s")).withColumn("kept", F.lit("x")).withColumn("cell", F.lit(1))
    rows = quality.assess(docs, keep=("doc_id", "kept", "cell", "spans"))
    assert rows.columns == ["doc_id", "cell", "spans", *quality.COUNTS, "base_failed", "kept", "distance"]
    assert rows.count() == odd_docs.count() and rows.where("text IS NULL" if "text" in rows.columns else "n_words = 0").count() >= 3
    assert rows.where("distance IS NOT NULL").count() == 0  # too few rows for an estimate
    empty = no_docs.withColumn("lang", F.lit("x")).withColumn("source", F.lit("s"))
    assert quality.assess(empty).count() == 0
