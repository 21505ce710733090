"""Toxicity by weak supervision.

1. Terms: words and stems that mark toxic documents are found in at most ``LABELLED_ROWS`` labelled
   rows outside the held-out fold. A term must be frequent and precise, and appear in different
   surroundings, so that the words of one document with many copies do not count.
2. Voters: the terms are dealt to ``N_LEXICONS`` lexicon voters; a fixed lexicon and pattern voters
   (density, variety, insult beside second person, insult in a shouted word) join them.
3. Label model: votes of all documents outside the held-out fold are counted per pattern in Spark. EM on those counts estimates how often each
   voter fires on either class; the strongest dependencies between voters given the class form a
   tree (maximum spanning tree by conditional mutual information), and EM runs again with every
   voter depending on the class and on its parent. This gives P(toxic | votes).
4. Classifier: logistic regression on hashed words, stems and votes, fitted to the posterior labels
   of at most ``TRAINING_ROWS`` documents outside the held-out fold, and if all of these are of one
   class, of as many of the other class. It scores every whole text.

What is collected to the driver is bounded by parameters: terms, 2**voters patterns, weights.

Edge cases: NULL and empty texts get the score of a text without any feature; rows without a label
only lack a say in the terms; of several labels for one id the highest counts; with no labels at
all the fixed lexicon alone decides. Repeated rows are all scored; an empty table gives an empty
result; other columns of ``docs`` pass through untouched.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prequenta.llm.common import bucket_of, make_room, small_batches, table, written

LABELLED_ROWS = 20_000
TRAINING_ROWS = 20_000
N_HASHED = 1 << 15
N_LEXICONS = 6
STEMS = (4, 5, 6, 7, 8)
LEVELS = (1, 2, 3)
MIN_ROWS = 8
MIN_PRECISION = 0.9
MIN_CONTEXTS = 4.0
MAX_TERMS = 2_000
FOLDS = 5
HELD_OUT = 0
MEMO_WORDS = 150_000
TEXTS_AT_ONCE = 500

# A fixed lexicon of plain insults.
INSULTS = frozenset(
    "idiot idiots moron morons stupid imbecile loser losers scum trash garbage worthless pathetic disgusting clown filthy "
    "dumbass jerk bastard coward vermin".split()
)
SECOND_PERSON = frozenset("you your youre yourself u du dich dir deine tu te toi vous eres vosotros usted ustedes".split())
PATTERNS = ("fixed", "dense", "varied", "addressed", "shouted")
VOTERS = (*[f"lexicon_{i}" for i in range(N_LEXICONS)], *PATTERNS)

WORD = re.compile(r"\w+")


def _terms_of(word: str) -> list[str]:
    """The word, and its stems marked by a trailing star."""
    return [word, *[word[:n] + "*" for n in STEMS if len(word) >= n]]


def _document_terms(words: list[str]) -> set[str]:
    """All terms of a text: its words, and its stems with how often they occur at least: ``stem*2``."""
    stems = Counter(t for w in words for t in _terms_of(w)[1:])
    return {*words, *[f"{t}{n}" for t, count in stems.items() for n in LEVELS if count >= n]}


def _chosen(n: int, bound: int, key: str = "doc_id") -> Column:
    """Whether a row is among about ``bound`` of ``n`` rows by a hash of the key, all of them if there are fewer."""
    return F.lit(True) if n <= bound else F.pmod(F.xxhash64(key, F.lit(7)), F.lit(1 << 30)) < int((1 << 30) * bound / n)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of a few texts: only that many are held as Python objects, and written back at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, TEXTS_AT_ONCE):
            yield batch.slice(start, TEXTS_AT_ONCE)


def learn_terms(sample: DataFrame) -> list[str]:
    """Terms of the toxic class in (text, toxic) rows; the sample is bounded, so are the counts."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        seen: dict[str, list[int]] = defaultdict(lambda: [0, 0])

        def flush() -> pa.RecordBatch:
            counts = [pa.array([n[y] for n in seen.values()], pa.int64()) for y in (0, 1)]
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *counts], ["term", "clean", "toxic"])
            seen.clear()
            return out

        for batch in _slices(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term in _document_terms(WORD.findall((text or "").lower())):
                    seen[term][y] += 1
            if len(seen) >= MEMO_WORDS:
                yield flush()
        yield flush()

    frequent = (
        sample.mapInArrow(counted, "term string, clean long, toxic long")
        .groupBy("term")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where((F.col("toxic") >= MIN_ROWS) & (F.col("toxic") >= MIN_PRECISION * (F.col("toxic") + F.col("clean"))))
    )
    candidates = {r["term"]: r["toxic"] for r in frequent.orderBy(F.desc("toxic"), "term").limit(50 * MAX_TERMS).collect()}
    if not candidates:
        return []
    names = sample.sparkSession.sparkContext.broadcast(frozenset(candidates))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, before = names.value, Counter()
        for batch in _slices(batches):
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if y:
                    words = WORD.findall((text or "").lower())
                    here = wanted.intersection(_document_terms(words))
                    levels = [t for t in here if "*" in t]
                    for a, w in zip(["", *words], words, strict=False):
                        before.update([(w, a)] if w in here else [])
                        before.update((t, a) for t in levels if w.startswith(t.partition("*")[0]))
        keys = list(before)
        columns = [pa.array([k[i] for k in keys], pa.string()) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([before[k] for k in keys], pa.int64())], ["term", "before", "n"])

    # Effective number of different words before a term: 1 / sum of squared shares.
    contexts = (
        sample.mapInArrow(placed, "term string, before string, n long")
        .groupBy("term", "before")
        .agg(F.sum("n").alias("n"))
        .groupBy("term")
        .agg((F.pow(F.sum("n"), 2) / F.sum(F.col("n") * F.col("n"))).alias("contexts"))
        .where(F.col("contexts") >= MIN_CONTEXTS)
    )
    varied = {r["term"] for r in contexts.collect()}
    kept: list[str] = []
    covered: set[str] = set()  # stems that count from their first occurrence on
    for term in sorted(varied, key=lambda t: (-candidates[t], len(t), t)):
        word, star, level = term.partition("*")
        if any(word.startswith(stem) for stem in covered):
            continue
        # A stem is only kept where no single word makes up most of it.
        if star and any("*" not in t and t.startswith(word) and candidates[t] >= 0.8 * candidates[term] for t in varied):
            continue
        kept.append(term)
        if level == "1":
            covered.add(word)
    return kept[:MAX_TERMS]


class Hashed(dict):
    """Lower-case word -> its hashed features."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= MEMO_WORDS:
            self.clear()
        self[word] = hashed = tuple({xxhash.xxh32_intdigest(t) % N_HASHED for t in _terms_of(word)})
        return hashed


class Voters:
    """Votes and features of one text."""

    def __init__(self, terms: list[str]):
        self.terms = terms
        self.lexicon = {t: i % N_LEXICONS for i, t in enumerate(terms)}
        self.stems = {t.partition("*")[0] + "*" for t in terms if "*" in t}
        self.hashed = Hashed()
        self.plain: set[str] = set()  # words met that no voter looks at

    def votes(self, text: str, words: list[str], kinds: set[str]) -> int:
        """Votes as bits; words are those of the text in lower case, kinds the different ones."""
        known: dict[str, list[str]] = {}
        for word in kinds - self.plain:
            counted = [t for t in _terms_of(word)[1:] if t in self.stems]
            if counted or word in INSULTS or word in self.lexicon:
                known[word] = [word, *counted]
            else:
                if len(self.plain) >= MEMO_WORDS:
                    self.plain.clear()
                self.plain.add(word)
        votes, fixed = 0, N_LEXICONS
        if known:
            counts = Counter(w for w in words if w in known)
            stems: Counter[str] = Counter()
            for word, names in known.items():
                for stem in names[1:]:
                    stems[stem] += counts[word]
            met = {t for t in known if t in self.lexicon}
            met.update(t for stem, n in stems.items() for level in LEVELS if n >= level and (t := f"{stem}{level}") in self.lexicon)
            roots = {t.partition("*")[0] + "*" * ("*" in t) for t in met} | INSULTS
            known = {w: names for w, names in known.items() if not roots.isdisjoint(names)}
            for term in met:
                votes |= 1 << self.lexicon[term]
            hits = sum(counts[w] for w in known)
            beside = any(w in known and SECOND_PERSON.intersection(words[max(0, i - 3) : i + 4]) for i, w in enumerate(words)) if known else False
            shouted = bool(known) and not text.isupper() and any(w.isupper() and len(w) > 2 and w.lower() in known for w in WORD.findall(text))
            pattern = (not INSULTS.isdisjoint(known), hits >= 2 + len(words) // 500, len(known) >= 2, beside, shouted)
            for j, fires in enumerate(pattern):
                votes |= fires << (fixed + j)
        return votes

    def read(self, text: str, wanted: bool = True) -> tuple[int, set[int] | None]:
        """(votes as bits, active features if wanted)."""
        words = WORD.findall(text.lower())
        kinds = set(words)
        votes = self.votes(text, words, kinds)
        if not wanted:
            return votes, None
        features = set().union(*map(self.hashed.__getitem__, kinds))
        features.update(N_HASHED + j for j in range(len(VOTERS)) if votes >> j & 1)
        return votes, features


def _patterns(votes: dict[int, int], m: int) -> tuple[np.ndarray, np.ndarray]:
    keys = sorted(votes)
    bits = np.array([[k >> j & 1 for j in range(m)] for k in keys], np.int64).reshape(len(keys), m)
    return bits, np.array([votes[k] for k in keys], np.float64)


def _expected(bits: np.ndarray, prior: float, rates: np.ndarray, parents: list[int]) -> np.ndarray:
    """P(y = 1 | pattern). rates[y, j, p] is P(voter j fires | y, its parent's vote p)."""
    log = np.log([1 - prior, prior])[:, None] * np.ones(len(bits))
    for j, parent in enumerate(parents):
        p = bits[:, parent] if parent >= 0 else np.zeros(len(bits), np.int64)
        for y in (0, 1):
            fires = rates[y, j][p]
            log[y] += np.where(bits[:, j], np.log(fires), np.log1p(-fires))
    return 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))


def _rates(bits: np.ndarray, n: np.ndarray, q: np.ndarray, parents: list[int]) -> np.ndarray:
    out = np.empty((2, bits.shape[1], 2))
    for y, weight in enumerate((n * (1 - q), n * q)):
        for j, parent in enumerate(parents):
            p = bits[:, parent] if parent >= 0 else np.zeros(len(bits), np.int64)
            for value in (0, 1):
                w = weight * (p == value)
                out[y, j, value] = ((w * bits[:, j]).sum() + 0.1) / (w.sum() + 1.0)
    return np.clip(out, 1e-6, 1 - 1e-6)


def _tree(bits: np.ndarray, n: np.ndarray, q: np.ndarray, least: float = 1e-3) -> list[int]:
    """Parent of each voter (-1: none) in the spanning forest of the strongest dependencies given the class."""
    m = bits.shape[1]
    edges = []
    for i in range(m):
        for j in range(i):
            mutual = 0.0
            for weight in (n * (1 - q), n * q):
                joint = np.array([[(weight * (bits[:, i] == a) * (bits[:, j] == b)).sum() for b in (0, 1)] for a in (0, 1)])
                p = (joint + 1e-9) / n.sum()
                mutual += (p * np.log(p * p.sum() / (p.sum(1, keepdims=True) * p.sum(0, keepdims=True)))).sum()
            edges.append((mutual, i, j))
    near: dict[int, list[int]] = defaultdict(list)
    group = list(range(m))
    for mutual, i, j in sorted(edges, reverse=True):
        if mutual >= least and group[i] != group[j]:
            group = [group[j] if g == group[i] else g for g in group]
            near[i].append(j)
            near[j].append(i)
    parents, done = [-1] * m, set()
    for root in range(m):
        todo = [root] if root not in done else []
        while todo:
            at = todo.pop()
            done.add(at)
            for to in near[at]:
                if to not in done:
                    parents[to] = at
                    todo.append(to)
    return parents


def label_model(votes: dict[int, int], m: int, prior: float, steps: int = 50) -> dict[int, float]:
    """P(toxic) of each pattern of m votes, from the counts of the patterns alone."""
    if not votes:
        return {}
    bits, n = _patterns(votes, m)
    parents = [-1] * m
    prior = min(max(prior, 1e-3), 0.5)
    rates = np.stack([np.full((m, 2), 0.01), np.full((m, 2), 0.5)])
    q = _expected(bits, prior, rates, parents)
    for part in range(2):
        if part:
            parents = _tree(bits, n, q)
        for _ in range(steps if part else 2):  # dependencies are found before they can mislead
            rates = _rates(bits, n, q, parents)
            prior = float(np.clip((n * q).sum() / n.sum(), 1e-4, 0.5))
            q = _expected(bits, prior, rates, parents)
    # Not one vote is never evidence for the class.
    return {k: float(p) if k else min(float(p), prior) for k, p in zip(sorted(votes), q, strict=True)}


class Model:
    """Terms, weights and intercept: all that scoring needs; its size is set by parameters."""

    def __init__(self, terms: list[str], weights: np.ndarray, intercept: float):
        self.terms, self.weights, self.intercept = terms, weights, intercept


def fit(docs: DataFrame, labels: DataFrame, text: str = "text") -> Model:
    """Learn from the rows of ``docs`` that are not held out, and the labels of a bounded part of them."""
    with small_batches(docs.sparkSession):
        return _fitted(docs, labels, text)


def _fitted(docs: DataFrame, labels: DataFrame, text: str) -> Model:
    spark = docs.sparkSession
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where("toxic IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.least(F.max("toxic"), F.lit(1)).alias("toxic"))
        .where(bucket_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    )
    known = known.where(_chosen(known.count(), LABELLED_ROWS))
    body = docs.select("doc_id", F.coalesce(F.col(text), F.lit("")).alias("text"))
    sample = written(body.join(F.broadcast(known), "doc_id").select("text", "toxic"), "toxic-sample")
    rate = sample.agg(F.avg("toxic")).first()[0]
    voters = Voters(learn_terms(sample))
    shared = spark.sparkContext.broadcast(voters)

    learnt = body.where(bucket_of(F.col("doc_id"), FOLDS) != HELD_OUT)
    total = learnt.count()

    def reader(patterns: frozenset[int] | None = None):
        """Reads (text, chosen): the votes, and the features of chosen rows with one of these patterns (None: any)."""

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            make_room()
            for batch in _slices(batches):
                votes, active = [], []
                for text, chosen in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    got = shared.value.read(text, chosen and patterns is None)
                    if chosen and patterns is not None and got[0] in patterns:
                        got = shared.value.read(text)
                    votes.append(got[0])
                    active.append(None if got[1] is None else sorted(got[1]))
                yield pa.RecordBatch.from_arrays([pa.array(votes, pa.int64()), pa.array(active, pa.list_(pa.int32()))], ["votes", "active"])

        return read

    # One pass over all documents: every row has its votes, those of the sample their features too.
    kind = "votes long, active array<int>"
    rows = written(learnt.select("text", _chosen(total, TRAINING_ROWS).alias("chosen")).mapInArrow(reader(), kind), "toxic-training")
    counted = rows.groupBy("votes").agg(F.count("*").alias("n"), F.count("active").alias("sampled")).collect()
    counts = {r["votes"]: r["n"] for r in counted}
    posterior = label_model(counts, len(VOTERS), 0.1 if rate is None else float(rate))
    none = np.zeros(N_HASHED + len(VOTERS))
    if len({p >= 0.5 for p in posterior.values()}) < 2:
        none[N_HASHED:] = 2.0
        return Model(voters.terms, none, -3.0)
    size = N_HASHED + len(VOTERS)
    rows = rows.where("active IS NOT NULL").withColumn("rows", F.lit(max(1.0, total / TRAINING_ROWS)))
    missing = {True, False} - {posterior[r["votes"]] >= 0.5 for r in counted if r["sampled"]}
    if missing:  # a class too rare for the sample, which alone would teach nothing
        rare = {k: n for k, n in counts.items() if (posterior[k] >= 0.5) in missing}
        n = sum(rare.values())
        more = learnt.select("text", _chosen(n, TRAINING_ROWS).alias("chosen")).mapInArrow(reader(frozenset(rare)), kind)
        more = written(more.where("active IS NOT NULL"), "toxic-rare")
        rows = rows.unionByName(more.withColumn("rows", F.lit(max(1.0, n / TRAINING_ROWS))))
    vector = F.udf(lambda active: SparseVector(size, active, [1.0] * len(active)), VectorUDT())
    pairs = spark.createDataFrame([(k, p) for k, p in posterior.items()], "votes long, p double")
    # A soft label is the two hard ones, weighted.
    both = rows.join(F.broadcast(pairs), "votes").select(
        "active", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("weight")), F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("weight")))).alias("x"), "rows"
    ).where("x.weight > 0.02").select(vector("active").alias("features"), "x.label", (F.col("x.weight") * F.col("rows")).alias("weight"))
    fitted = LogisticRegression(maxIter=40, regParam=3e-4, standardization=False, weightCol="weight").fit(both)
    return Model(voters.terms, fitted.coefficients.toArray(), float(fitted.intercept))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with ``score`` (0 to 1) and ``predicted``, in place of columns of these names."""
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    schema = T.StructType([f for f in docs.schema.fields if f.name in keep] + list(T.StructType.fromDDL("score double, predicted int").fields))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room()
        model = shared.value
        voters, weights = Voters(model.terms), model.weights
        for batch in _slices(batches):
            margins = []
            for value in batch.column(text).to_pylist():
                active = np.array(sorted(voters.read(value or "")[1]), np.int64)
                margins.append(weights[active].sum() + model.intercept)
            p = 1 / (1 + np.exp(-np.clip(margins, -60, 60)))
            out = [pa.array(p, pa.float64()), pa.array((p >= 0.5).astype(np.int32))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *out], [*keep, "score", "predicted"])

    return docs.select(*keep).mapInArrow(run, schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    held_out = bucket_of(F.col("doc_id"), FOLDS) == HELD_OUT
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
