"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Texts are folded first: case, homoglyphs of other scripts, accents left alone, and digits or signs that stand for letters inside a
word. The automaton finds whole words and word beginnings; matches inside an exception phrase don't count. The sum of the
weights of the matches, over a root of the length, is the feature of a logistic score.

Weights are learned: document counts of folded words and word beginnings over a bounded sample of labelled rows (``SAMPLE`` per
label, by a hash of the id) give log-odds. The lexicon keeps at most ``ENTRIES`` of the words that stand mostly in toxic texts, those in most of these: what is left out
stands in fewer sampled toxic texts than any entry. A seed lexicon holds without labels.
Defined results: a null or empty text has the score of a text without matches; without usable labels the seed weights and a
fixed calibration serve; repeated rows get equal scores; very long texts are read whole; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Labelled rows per label that fitting sees at most, and entries of the lexicon.
SAMPLE, ENTRIES = 6000, 4000
#: A feature needs this many toxic documents, and this share of toxic among the documents that have it.
LEAST, PURE = 3, 0.75
PREFIXES = (4, 5, 6)
#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = str.maketrans("аеорсухіјѕԁһкмтвнӏαεορτυνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧАВЕКМНОРСТУХІЅЈ０１３４５７", "aeopcyxijsdhkmtbhlaeoptuvikABEZHIKMNOPTYXABEKMHOPCTYXISJ013457")
#: Digits and signs that stand for letters.
SIGNS = str.maketrans("0134578@$!|", "oieastbasil")
#: Seed lexicon (weights) and phrases in which its words are harmless.
SEED = {" idiot ": 3.0, " moron ": 3.0, " stupid ": 2.5, " scum ": 3.0, " loser ": 2.5, " worthless ": 2.5, " pathetic ": 2.5, " disgusting ": 2.5}
EXCEPTIONS = (" trash can ", " trash bin ", " clown fish ", " clown college ", " sore loser ", " pond scum ")
WORD = re.compile(r"[^\W_]+(?:[0-9@$!|]+[^\W\d_]+)*")
CODED = re.compile(r"(?<![0-9@$!|])[0134578@$!|]{1,2}(?=[^\W\d_])|(?<=[^\W\d_])[0134578](?![^\W])")


def folded(text: str | None) -> str:
    """Words in folded form, one space around each."""
    t = (text or "").translate(HOMOGLYPHS).lower()
    if re.search(r"[0-9@$!|]", t):
        t = CODED.sub(lambda m: m[0].translate(SIGNS), t)
    return " " + " ".join(WORD.findall(t)) + " "


def features(text: str | None) -> set[str]:
    words = set(folded(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) >= n}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float = -3.0
    slope: float = 6.0
    exceptions: tuple[str, ...] = EXCEPTIONS


def within(at: int, stretches: list[list[int]]) -> bool:
    """True if one of the sorted, separate stretches [from, to) holds ``at``."""
    i = bisect_right(stretches, at, key=lambda x: x[0]) - 1
    return i >= 0 and at < stretches[i][1]


class Scorer:
    def __init__(self, model: Model):
        import ahocorasick

        self.model, self.auto = model, ahocorasick.Automaton()
        for phrase in model.exceptions:
            self.auto.add_word(phrase, (len(phrase), None))
        for entry, w in model.weights.items():
            if not self.auto.exists(entry):
                self.auto.add_word(entry, (len(entry), w))
        if len(self.auto):
            self.auto.make_automaton()

    def signal(self, text: str | None) -> float:
        """Weight a root of length: at most one match a word counts, the heaviest."""
        t = folded(text)
        words = t.count(" ") - 1
        if words <= 0 or not len(self.auto):
            return 0.0
        best: dict[int, float] = {}
        free: list[list[int]] = []  # stretches of exception phrases, in order and apart: matches come in the order of their ends
        for end, (n, w) in self.auto.iter(t):
            start = end - n + 1
            if w is None:
                while free and free[-1][1] >= start:
                    start = min(start, free.pop()[0])
                free.append([start, end])
            elif w > best.get(start, 0.0):
                best[start] = w
        return sum(w for s, w in best.items() if not within(s, free)) / math.sqrt(words + 20)

    def score(self, text: str | None) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.model.bias + self.model.slope * math.log1p(self.signal(text))))))


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """(doc_id, text, toxic): at most ``sample`` rows a label; the ids picked are few enough to broadcast by that bound."""
    one = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    pick = lambda v: one.where(F.col("toxic") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    few = pick(0).unionByName(pick(1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, entries: int = ENTRIES) -> Model:
    """Lexicon weights and calibration from labelled rows; a training filter belongs before this call."""
    rows = materialize(sampled(docs, labels, sample), "labelled")  # read twice below

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for b in batches:
            for text, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                seen[y].update(features(text))
                seen[y][""] += 1
        keys = list(seen[0].keys() | seen[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([seen[1][k] for k in keys], pa.int64()), pa.array([seen[0][k] for k in keys], pa.int64())], names=["f", "t", "c"])

    counts = rows.mapInArrow(count, "f string, t long, c long").groupBy("f").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    kept = counts.where((F.col("f") == "") | ((F.col("t") >= LEAST) & (F.col("t") >= PURE * (F.col("t") + F.col("c"))))).orderBy(F.col("f") != "", F.desc("t"), "f").limit(entries + 1)
    found = {r["f"]: (r["t"], r["c"]) for r in kept.collect()}
    n_tox, n_clean = found.pop("", (0, 0))
    if not n_tox or not n_clean or not found:
        return Model(SEED)
    weights = {f: math.log((t + 0.5) / (n_tox + 1)) - math.log((c + 0.5) / (n_clean + 1)) for f, (t, c) in found.items()}
    weights = {f: min(8.0, w) for f, w in weights.items() if w > 1}
    for f, w in SEED.items():
        weights.setdefault(f, w)
    raw = Model(weights)

    def signals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(raw)
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([s.signal(t) for t in b.column(1).to_pylist()], pa.float64()), b.column(2)], names=["x", "y"])

    xy = rows.mapInArrow(signals, "x double, y int").collect()  # two numbers a sampled row
    x, y = np.log1p([r["x"] for r in xy]), np.array([r["y"] for r in xy], float)
    bias, slope = -3.0, 3.0
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(bias + slope * x, -40, 40)))
        g = np.array([(p - y).sum() + 0.01 * bias, ((p - y) * x).sum() + 0.01 * slope])
        v = np.maximum(p * (1 - p), 1e-6)
        h = np.array([[v.sum() + 0.01, (v * x).sum()], [(v * x).sum(), (v * x * x).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        bias, slope = bias - step[0], slope - step[1]
        if abs(step).max() < 1e-6:
            break
    return Model(weights, float(bias), float(max(slope, 0.1)))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
