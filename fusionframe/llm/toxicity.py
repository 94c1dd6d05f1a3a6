"""Toxicity from misspelling-tolerant lexicon hits and their context."""

from __future__ import annotations

import functools
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import all_but, load, materialize
from .langid import held_out
from .minhash import shingles

WORD = re.compile(r"\w+|[\"“”«»]")
LETTERS = re.compile(r"\w{3,}")
QUOTES = frozenset('"“”«»')
#: Words that report or question a term instead of using it.
REPORTING = frozenset("said says called quote quoted word term slur reported wrote".split())
FEATURES = 5
FAMILY = 4


def labelled_rows(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000) -> DataFrame:
    """(text, toxic) of labelled rows, one of each text: a bounded sample to fit on.

    About `sample_rows` labelled doc_ids, picked by a hash of the id before any text is read; so
    few are broadcast, and only their texts move. Of near copies one row stays (those that share one
    of `FAMILY` least hashes of five-word shingles), as they are no evidence of their own. A text
    under both labels counts as toxic; rows with null text or label are left out.
    """
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marks.count()
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) / 1e6
    picked = marks.where(place < min(1.0, sample_rows / max(1, n)))
    joined = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    rows = joined.groupBy(F.md5("text").alias("same")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))

    def least_hashes(batches):
        for batch in batches:
            least = []
            for text in batch.column("text").to_pylist():
                h = shingles(text, 5)
                least.append([int((h * np.uint64(2 * k + 3)).min() >> np.uint64(1)) if len(h) else 0 for k in range(FAMILY)])
            yield batch.append_column("least", pa.array(least, pa.list_(pa.int64())))

    rows = rows.mapInArrow(least_hashes, "same string, text string, toxic int, least array<long>")
    for k in range(FAMILY):  # at most `sample_rows` rows
        first = F.min_by(F.struct("same", "text", "toxic", "least"), F.struct(-F.col("toxic"), F.col("same")))
        rows = rows.groupBy(F.col("least")[k]).agg(first.alias("r")).select("r.*")
    return rows.select("text", "toxic")


def terms_of(text: str) -> Counter:
    """Words of 3 letters or more, and the starts of 4 to 8 letters of longer ones with a closing `*`, with their counts."""
    held = Counter(LETTERS.findall(text.lower()))
    for word, n in list(held.items()):
        for k in range(4, min(8, len(word)) + 1):
            held[word[:k] + "*"] += n
    return held


def choose_terms(tallies: list[tuple], n_toxic: int, n_clean: int, candidates: int, alpha: float = 0.05) -> list[str]:
    """Terms whose rows are toxic beyond chance.

    `tallies` holds (term, toxic, clean) rows with the term, and with it twice. A term stays if its
    log-likelihood ratio passes a test at level alpha / candidates and its odds are 12 or more. Of
    stems that start alike only the strongest stays; whole words under a stem too short for misspellings stay too.
    """
    limit = 2 * math.log(max(1, candidates) / alpha)
    share = n_toxic / max(1, n_toxic + n_clean)

    def weight(t, c):
        if t < 2 or not 0 < share < 1 or (t / n_toxic) < 12 * (c + 0.5) / n_clean:
            return 0.0
        g = 2 * (t * math.log(t / ((t + c) * share)) + (c * math.log(c / ((t + c) * (1 - share))) if c else 0.0))
        return g if g >= limit else 0.0

    scored = [(max(weight(t1, c1), weight(t2, c2)), term) for term, t1, c1, t2, c2 in tallies]
    ranked = sorted(((w, t) for w, t in scored if w), key=lambda x: (-x[0], x[1].endswith("*"), -len(x[1]), x[1]))
    stems: list[str] = []
    for _, term in ranked:
        if term.endswith("*") and not any(term[:-1].startswith(k) or k.startswith(term[:-1]) for k in stems):
            stems.append(term[:-1])
    sure = tuple(s for s in stems if len(s) >= 5)  # their own misspellings are caught, so words under them add nothing
    return [t for _, t in ranked if not t.endswith("*") and not t.startswith(sure)] + [s + "*" for s in stems]


def learn_lexicon(rows: DataFrame, alpha: float = 0.05) -> list[str]:
    """The terms of `choose_terms` over all rows of (text, toxic); as many as the bounded sample can hold."""
    sizes = rows.agg(F.count_if(F.col("toxic") == 1), F.count_if(F.col("toxic") == 0)).first()
    names = ["t1", "c1", "t2", "c2"]

    def tally(batches):
        counts: dict[str, list[int]] = {}

        def flush():
            cells = list(zip(*counts.values()))
            out = pa.RecordBatch.from_arrays([pa.array(list(counts)), *[pa.array(c, pa.int64()) for c in cells]], ["term", *names])
            counts.clear()
            return out

        for batch in batches:
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                side = 0 if toxic == 1 else 1
                for term, n in terms_of(text).items():
                    cell = counts.setdefault(term, [0, 0, 0, 0])
                    cell[side] += 1
                    cell[side + 2] += n > 1
                if len(counts) > 300_000:
                    yield flush()
        if counts:
            yield flush()

    per = materialize(rows.select("text", "toxic").mapInArrow(tally, "term string, t1 long, c1 long, t2 long, c2 long")
                      .groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).where("t1 > 1"), "terms")
    candidates = per.count()
    likely = per.where(f"t1 * {sizes[1] or 1} >= 12 * (c1 + 0.5) * {sizes[0] or 1} or t2 * {sizes[1] or 1} >= 12 * (c2 + 0.5) * {sizes[0] or 1}")
    return choose_terms([tuple(r) for r in likely.select("term", *names).collect()], sizes[0], sizes[1], candidates, alpha)


class LexiconTrie:
    """Terms as a trie, walked together with the Levenshtein automaton of a word."""

    def __init__(self, terms, min_fuzzy: int = 5, min_stem: int = 5):
        self.root, self.min_fuzzy, self.min_stem = {}, min_fuzzy, min_stem
        self.starts, self.middles = set(), set()
        for term in terms:
            node, word = self.root, term.rstrip("*")
            for ch in word:
                node = node.setdefault(ch, {})
            node["stem" if term.endswith("*") else ""] = len(word)
            if len(word) >= min(min_fuzzy, min_stem):
                self.starts.add(word[:2])
                self.middles.add(word[2:5])

    def match(self, word: str) -> int:
        """2 for a term or a word with a stem, 1 for one edit away from a word of at least `min_fuzzy`
        letters or from a word that starts with a stem of at least `min_stem`, else 0."""
        node = self.root
        for ch in word:
            node = node.get(ch)
            if node is None:
                break
            if "stem" in node:
                return 2
        if node and "" in node:
            return 2
        # One edit leaves the first two letters as they are, or the next three, moved by one at most.
        middles = self.middles
        if word[:2] in self.starts or word[2:5] in middles or word[1:4] in middles or word[3:6] in middles:
            return int(self._one_edit(word))
        return 0

    def _one_edit(self, word: str) -> bool:
        """Walk the trie and the automaton from state (i letters read, no edit) to those with one edit."""
        node, size = self.root, len(word)
        for i in range(size + 1):
            if i < size and self._exact(node, word, i + 1):
                return True
            for ch, child in node.items():
                if len(ch) == 1 and (self._exact(child, word, i) or i < size and self._exact(child, word, i + 1)):
                    return True
            node = node.get(word[i]) if i < size else None
            if node is None:
                return False
        return False

    def _exact(self, node: dict, word: str, i: int) -> bool:
        """Whether the letters from i on lead from a node to an accepting state, the edit being used."""
        size = len(word)
        while True:
            if node.get("stem", 0) >= self.min_stem or (i == size and node.get("", 0) >= self.min_fuzzy):
                return True
            node = node.get(word[i]) if i < size else None
            if node is None:
                return False
            i += 1


class _Memo(dict):
    """Kinds of words seen; emptied beyond 300,000."""

    def __init__(self, terms):
        self.trie = LexiconTrie(terms)

    def __missing__(self, word):
        kind = self.trie.match(word)
        if len(word) < 64:  # longer ones are looked up each time, which ends where the walk leaves the trie
            if len(self) > 300_000:
                self.clear()
            self[word] = kind
        return kind


@functools.lru_cache(maxsize=2)
def _matcher(terms: tuple):
    return _Memo(terms).__getitem__


def features(text: str | None, terms: tuple, window: int = 6) -> list[float]:
    """Exact hits, misspelled hits, quoted hits, hit density and presence of a misspelled hit, of the whole text."""
    match, quoted_now = _matcher(terms), False
    tokens = WORD.findall((text or "").lower())
    exact = fuzzy = quoted = 0
    kinds = [match(t) for t in tokens]
    if not any(kinds):
        return [0.0] * FEATURES
    for i, (token, kind) in enumerate(zip(tokens, kinds)):
        if token in QUOTES:
            quoted_now = not quoted_now
            continue
        if kind:
            near = tokens[max(0, i - window):i + window + 1]
            closed = quoted_now and any(t in QUOTES for t in near)
            if closed or any(t in REPORTING for t in near):
                quoted += 1
            elif kind == 2:
                exact += 1
            else:
                fuzzy += 1
    return [np.log1p(exact), np.log1p(fuzzy), np.log1p(quoted), min(1.0, 20.0 * exact / max(1, len(tokens))),
            float(exact + fuzzy > 0)]


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge logistic model by Newton's method."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(w))
        w -= np.linalg.solve(hessian, x.T @ (p - y) + 0.1 * w)
    return w


def fit(rows: DataFrame, terms: list[str]) -> list[float]:
    """Weights of a logistic model of the features of all rows of the bounded sample; only features reach the driver."""
    terms = tuple(terms)

    @F.pandas_udf("array<double>")
    def extract(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t, terms) for t in texts])

    sample = rows.select("toxic", extract("text").alias("x")).toPandas()
    if not len(sample):
        return [0.0] * FEATURES + [-3.0]
    x = np.c_[np.array(sample["x"].tolist()).reshape(len(sample), FEATURES), np.ones(len(sample))]
    return logistic(x, sample["toxic"].to_numpy(float)).tolist()


def score_toxicity(docs: DataFrame, terms: list[str], weights: list[float]) -> DataFrame:
    """Add `score` (0 to 1), in place of any column of that name, to rows with a `text`; null and empty texts score as having no hit."""
    terms, w = tuple(terms), np.array(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([[*features(t, terms), 1.0] for t in texts]).reshape(len(texts), FEATURES + 1)
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ w, -30, 30))))

    packed = docs.select(F.struct(*all_but(docs, "score")).alias("_row"), score("text").alias("_s"))
    return packed.select("_row.*", F.col("_s").alias("score"))


def train_and_score(docs: DataFrame, training: DataFrame, labels: DataFrame) -> DataFrame:
    rows = materialize(labelled_rows(training, labels), "labelled")
    terms = learn_lexicon(rows)
    return score_toxicity(docs, terms, fit(rows, terms))


def op9_toxicity(spark, sf_dir) -> DataFrame:
    """The toxicity score of every whole text; terms and weights are learned from labelled rows that are not held out."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", held_out().alias("held_out"))
    labels = load(spark, sf_dir, "labels").select("doc_id", "toxic")
    out = train_and_score(docs, docs.where(~F.col("held_out")), labels)
    return out.select("doc_id", "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
