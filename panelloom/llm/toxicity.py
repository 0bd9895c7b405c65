"""Toxicity: boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import stage

_WORD = re.compile(r"[^\W\d_]+")
_CHUNK = re.compile(r"\S+")
#: Letters between or beside digits and signs: spellings that hide a word.
_HIDDEN = re.compile(r"[^\W\d_]+(?:[@$!*#\d|+]+[^\W\d_]+)+|(?<!\S)(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?!\S)")
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
#: Signs read as the letters they stand for.  Fixed values.
_LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t"})
#: Second-person words of the common European languages.  Fixed values.
YOU = frozenset(
    "you your yours yourself u ur du dich dir dein deine deinen deiner deines ihr euch euer sie ihnen "
    "tu te toi ton ta tes vous votre vos tú ti usted ustedes vosotros vuestro tus".split()
)
STEMS = (4, 5, 6)
NEAR = 5
FEATURES = (
    "lexicon_per_100", "lexicon_hits", "lexicon_kinds", "weight_per_word", "weight_sum", "strongest", "stem_per_100",
    "hidden_hits", "near_you_per_100", "capital_hits", "you_per_100", "capitals", "capital_words", "marks", "exclamations",
    "hidden_per_100", "stretched_per_100", "densest", "log_words",
)


def terms_of(text: str | None) -> set[str]:
    """Lower-case words of a text and their beginnings (marked by a trailing *)."""
    words = {w.lower() for w in _WORD.findall(text or "")}
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


@dataclass(frozen=True)
class Lexicon:
    """Terms that labelled texts show to be toxic, with their log odds."""

    weight: dict[str, float]

    def of(self, word: str) -> tuple[float, bool]:
        """Weight of a word, else of its longest known beginning; whether it was a beginning."""
        if w := self.weight.get(word):
            return w, False
        for n in STEMS[::-1]:
            if len(word) > n and (w := self.weight.get(word[:n] + "*")):
                return w, True
        return 0.0, False


def learn_lexicon(labelled: DataFrame, most_terms: int = 4000, least_texts: int = 4, least_odds: float = 6.0) -> Lexicon:
    """Terms whose smoothed odds of standing in a toxic text are ``least_odds`` times the
    usual ones, in at least ``least_texts`` toxic texts; the ``most_terms`` strongest.

    ``labelled``: ``text``, ``toxic``.  Texts are counted per term in Spark; only the chosen
    terms come to the driver.
    """

    @F.pandas_udf("array<string>")
    def terms(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(terms_of(t)) for t in texts])

    sizes = {r.toxic: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    bad, good = max(sizes.get(1, 0), 1), max(sizes.get(0, 0), 1)
    counted = labelled.select("toxic", F.explode(terms("text")).alias("term")).groupBy("term").agg(
        F.sum("toxic").alias("b"), F.sum(1 - F.col("toxic")).alias("g")
    )
    odds = F.log((F.col("b") + 0.5) / (bad + 1) / ((F.col("g") + 0.5) / (good + 1)))
    chosen = counted.where(F.col("b") >= least_texts).withColumn("w", odds).where(F.col("w") >= float(np.log(least_odds)))
    top = chosen.orderBy(F.desc(F.col("w") * F.sqrt("b")), "term").limit(most_terms).collect()
    return Lexicon({r.term: float(r.w) for r in top})


def features_of(text: str | None, lexicon: Lexicon) -> list[float]:
    """The dense features of one whole text, in the order of FEATURES."""
    text = text or ""
    known, of = lexicon.weight, lexicon.of
    seen: dict[str, tuple[float, bool]] = {}
    hits: list[tuple[int, float]] = []
    you: list[int] = []
    n = capital_words = capital_hits = stems = 0
    kinds: set[str] = set()
    for n, word in enumerate(_WORD.findall(text), 1):
        low = word.lower()
        if low not in seen:
            seen[low] = of(low)
        w, stem = seen[low]
        if low in YOU:
            you.append(n)
        if len(word) > 1 and word.isupper():
            capital_words += 1
            capital_hits += w > 0
        if w:
            hits.append((n, w))
            kinds.add(low[:5])
            stems += stem
    words = max(n, 1)
    hidden = _HIDDEN.findall(text)
    hidden_hits = 0
    for h in hidden:
        plain = re.sub(r"[^\w]|[\d_]", "", h.translate(_LEET)).lower()
        hidden_hits += any(plain == k or k.endswith("*") and plain.startswith(k[:-1]) for k in (plain, *(plain[:s] + "*" for s in STEMS)) if k in known)
    near = 0
    for at, _ in hits:
        i = bisect.bisect_left(you, at - NEAR)
        near += i < len(you) and you[i] <= at + NEAR
    total = sum(w for _, w in hits)
    densest = first = 0
    for i, (at, _) in enumerate(hits):  # most hits among any 50 words
        while hits[first][0] < at - 50:
            first += 1
        densest = max(densest, i - first + 1)
    chars = max(len(text), 1)
    printed = max(len(text) - text.count(" "), 1)
    marks = sum(text.count(c) for c in "!?.,;:")
    return [
        100.0 * len(hits) / words, float(len(hits)), float(len(kinds)), total / words, total, max((w for _, w in hits), default=0.0),
        100.0 * stems / words, float(hidden_hits), 100.0 * near / words, float(capital_hits), 100.0 * len(you) / words,
        sum(map(str.isupper, text)) / printed, capital_words / words, marks / chars, text.count("!") / chars,
        100.0 * len(hidden) / words, 100.0 * len(_STRETCHED.findall(text)) / words, float(densest), float(np.log1p(n)),
    ]


def with_features(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    @F.pandas_udf("array<double>")
    def dense(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([features_of(t, lexicon) for t in part])

    return docs.withColumn("dense", dense(F.col(text)))


@dataclass(frozen=True)
class Model:
    """Lexicon, trees (split features, thresholds, leaves) and isotonic calibration."""

    lexicon: Lexicon
    trees: tuple
    at: tuple[float, ...]
    score: tuple[float, ...]


def _tree(node) -> tuple:
    """A fitted tree as nested tuples: (feature, threshold, left, right) or a leaf's value."""
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def _walk(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, float):
        return np.full(len(x), tree)
    feature, threshold, left, right = tree
    goes = x[:, feature] <= threshold
    out = np.empty(len(x))
    out[goes], out[~goes] = _walk(left, x[goes]), _walk(right, x[~goes])
    return out


def margin(trees: tuple, x: np.ndarray) -> np.ndarray:
    """Weighted sum of the trees; higher means likelier toxic."""
    return sum((w * _walk(t, x) for w, t in trees), np.zeros(len(x)))


def train(docs: DataFrame, labels: DataFrame, most_labels: int = 12_000, rounds: int = 20, depth: int = 3, seed: int = 5) -> Model | None:
    """Fit on a bounded sample of about ``most_labels`` labelled rows, chosen by hash.

    A third of the sample gives the lexicon, a third the trees (so the trees see words that
    the lexicon was not made from) and a third the calibration.  None if a class is missing.
    """
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("long").alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    if not (counts.get(0) and counts.get(1)):
        return None
    million = 1_000_000
    share = int(min(1.0, most_labels / sum(counts.values())) * million)
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(million)) < share)
    sample = stage(docs.select("doc_id", "text").join(chosen, "doc_id").withColumn("third", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(3))), "toxic-sample")
    lexicon = learn_lexicon(sample.where("third = 0"))
    data = stage(with_features(sample.where("third > 0"), lexicon).select("third", F.col("toxic").cast("double").alias("label"), "dense"), "toxic-features")
    grow = data.where("third = 1")
    if grow.select("label").distinct().count() < 2:
        return None
    points = grow.select("label", array_to_vector("dense").alias("features")).coalesce(4)
    fitted = GBTClassifier(maxIter=rounds, maxDepth=depth, stepSize=0.2, seed=seed, minInstancesPerNode=5, cacheNodeIds=False).fit(points)
    roots = [t.rootNode() for t in fitted._call_java("trees")]
    trees = tuple(zip(map(float, fitted.treeWeights), map(_tree, roots)))
    held = data.where("third = 2").select("label", _margin_column(trees, F.col("dense")).alias("m"))
    steps = IsotonicRegression(featuresCol="m", labelCol="label").fit(held)
    return Model(lexicon, trees, tuple(map(float, steps.boundaries.toArray())), tuple(map(float, steps.predictions.toArray())))


def _margin_column(trees: tuple, dense: Column) -> Column:
    @F.pandas_udf("double")
    def value(rows: pd.Series) -> pd.Series:
        return pd.Series(margin(trees, np.stack(rows.to_numpy())) if len(rows) else np.zeros(0))

    return value(dense)


def score(docs: DataFrame, model: Model | None, threshold: float = 0.7) -> DataFrame:
    """Score every whole text of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id``, ``score`` (calibrated share of toxic labels, 0 to 1) and
    ``predicted`` (1 if score >= threshold), one row per input row.  A null or empty text
    has all features 0; rows that repeat get equal scores; without a model (no labels of
    both kinds) every score is 0; other columns are ignored; an empty table gives no rows.
    """
    if model is None:
        out = docs.select("doc_id", F.lit(0.0).alias("score"))
    else:
        lexicon, trees, at, level = model.lexicon, model.trees, model.at, model.score

        @F.pandas_udf("double")
        def value(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                dense = np.array([features_of(t, lexicon) for t in part]).reshape(len(part), len(FEATURES))
                yield pd.Series(np.interp(margin(trees, dense), at, level))

        out = docs.select("doc_id", value("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
