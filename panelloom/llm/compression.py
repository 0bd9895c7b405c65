"""Quality classifier by compression: a text resembles the class whose dictionary shrinks it more."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVEL = 3
#: Texts are compressed in runs of this many bytes, so that a dictionary keeps its effect on
#: long texts.
RUN_BYTES = 2048


@dataclass(frozen=True)
class Model:
    """Dictionaries of good and bad text, and the calibration: score at rising differences."""

    good: bytes
    bad: bytes
    at: tuple[float, ...]
    score: tuple[float, ...]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_checksum=False, write_content_size=False, write_dict_id=False)


def difference_of(good: bytes, bad: bytes):
    """A function from a text to (bytes with the bad dictionary - bytes with the good one) /
    the larger of both, over all runs of the whole text; 0 for an empty text."""
    by_good, by_bad = _compressor(good).compress, _compressor(bad).compress

    def difference(text: str | None) -> float:
        raw = (text or "").encode()
        a = b = 0
        for i in range(0, len(raw), RUN_BYTES):
            run = raw[i : i + RUN_BYTES]
            a += len(by_good(run))
            b += len(by_bad(run))
        return (b - a) / max(a, b, 1)

    return difference


def differences(text: Column, good: bytes, bad: bytes) -> Column:
    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = difference_of(good, bad)
        for part in parts:
            yield pd.Series([of(t) for t in part], dtype="float64")

    return score(text)


def rising(x: np.ndarray, y: np.ndarray, bins: int = 200) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """Calibration: share of good texts as a rising function of the difference.

    Equal-count bins, smoothed by one text of the average kind,
    pooled until the shares rise (pool adjacent violators)."""
    order = np.argsort(x, kind="stable")
    x, y = x[order], y[order]
    base = float(y.mean())
    pools: list[list[float]] = []  # good, rows, sum of x
    for part in np.array_split(np.arange(len(x)), max(1, min(bins, len(x) // 10))):
        pools.append([float(y[part].sum()), float(len(part)), float(x[part].sum())])
        while len(pools) > 1 and pools[-2][0] / pools[-2][1] >= pools[-1][0] / pools[-1][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    return tuple(p[2] / p[1] for p in pools), tuple((p[0] + base) / (p[1] + 1.0) for p in pools)


def calibrated(at: tuple[float, ...], score: tuple[float, ...], x: Column) -> Column:
    """Linear between the calibration's points, level beyond them."""

    @F.pandas_udf("double")
    def look(d: pd.Series) -> pd.Series:
        return pd.Series(np.interp(d.to_numpy(), at, score))

    return look(x)


def _sample_dictionary(texts: list[bytes], size: int) -> bytes:
    """A trained dictionary; for too few texts, their plain content."""
    runs = [t[i : i + 1024] for t in texts for i in range(0, len(t), 1024)]
    try:
        return zstandard.train_dictionary(size, runs).as_bytes()
    except zstandard.ZstdError:
        return b"".join(runs)[-size:] or b" "


def train(docs: DataFrame, labels: DataFrame, most_labels: int = 8_000, run_chars: int = 4096, dictionary_bytes: int = 64 << 10) -> Model | None:
    """Fit on a bounded sample of labelled rows: about ``most_labels``, chosen by hash.

    Half of them give dictionary text, at most one stretch of ``run_chars`` characters each,
    as many good ones as bad ones where there are enough; the other half are scored whole and
    give the calibration.  Only those stretches and numbers come to the driver.  None if a
    class is missing.
    """
    known = labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    counts = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    if not (counts.get(0) and counts.get(1)):
        return None
    total = counts[0] + counts[1]
    million = 1_000_000
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(million))
    some = docs.select("doc_id", "text").join(known.where(draw < int(min(1.0, most_labels / total) * million)), "doc_id")
    side = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(2)) == 0
    from_char = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.greatest(F.char_length("text") - run_chars, F.lit(1))).cast("int") + 1
    lead = min(1.0, counts[0] / counts[1])  # thin the more frequent class
    even = F.pmod(F.xxhash64("doc_id", F.lit(19)), F.lit(million)) < F.when(F.col("good") == 1, int(lead * million)).otherwise(int(min(1.0, 1 / lead) * million))
    texts = some.where(side & even).select("good", F.substring("text", from_char, F.lit(run_chars)).alias("t")).where("t != ''").collect()
    own = [sorted(r.t.encode() for r in texts if r.good == g) for g in (0, 1)]
    if not (own[0] and own[1]):
        return None
    bad, good = (_sample_dictionary(t, dictionary_bytes) for t in own)
    scored = some.where(~side).select("good", differences(F.col("text"), good, bad).alias("x")).collect()
    if not scored:
        return None
    at, score = rising(np.array([r.x for r in scored]), np.array([r.good for r in scored], "float64"))
    return Model(good, bad, at, score)


def classify(docs: DataFrame, model: Model | None, threshold: float = 0.3) -> DataFrame:
    """Score every whole text of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id``, ``difference``, ``score`` (share of good labels expected, 0 to 1) and
    ``predicted`` (1 if score >= threshold), one row per input row.  Null and empty texts
    have difference 0; rows that repeat get equal scores; without a model (no labels of both
    kinds) every score is 1; other columns are ignored; an empty table gives no rows.
    """
    if model is None:
        out = docs.select("doc_id", F.lit(0.0).alias("difference"), F.lit(1.0).alias("score"))
    else:
        out = docs.select("doc_id", differences(F.col("text"), model.good, model.bad).alias("difference"))
        out = out.withColumn("score", calibrated(model.at, model.score, F.col("difference")))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

