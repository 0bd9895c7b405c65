"""Quality rules as a learned decision list over text statistics, in DataFrame functions only."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelloom.llm.common import WORD, stage

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
WINDOW = 5

_WORDS, _CHARS, _LINES = (f"greatest({c}, 1)" for c in ("n_words", "word_chars", "n_lines"))
#: What conditions may ask: name -> value per text, from the counted statistics.
FEATURE_SQL = {
    "symbols_per_char": f"n_symbols / {_CHARS}",
    "symbols_per_word": f"n_symbols / {_WORDS}",
    "capitals_per_char": f"n_capitals / {_CHARS}",
    "digits_per_char": f"n_digits / {_CHARS}",
    "marks_per_word": f"n_marks / {_WORDS}",
    "repeated_words": f"n_repeat_words / {_WORDS}",
    "distinct_words": f"n_distinct_words / {_WORDS}",
    "repeated_lines": f"n_dup_lines / {_LINES}",
    "word_length": f"word_chars / {_WORDS}",
    "short_words": f"n_short_words / {_WORDS}",
    "words_per_line": f"n_words / {_LINES}",
    "same_neighbours": f"n_same_neighbours / {_WORDS}",
}
FEATURES = tuple(FEATURE_SQL)


def _features() -> dict[str, Column]:
    return {name: F.expr(sql) for name, sql in FEATURE_SQL.items()}


def _without(text: Column, letters: str) -> Column:
    return F.length(F.translate(text, letters, ""))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` and the counted statistics of the whole text, computed row by row.

    Repeated five-word windows are found by hash: if no hash repeats there are none; else
    the windows are sorted by (hash, place), those equal to a neighbour are kept, and the
    words they cover are counted once each.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumn("_t", t).withColumn("_words", F.regexp_extract_all("_t", F.lit(WORD), F.lit(0)))
    d = d.withColumn("_lines", F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(WORD)))
    d = d.withColumn("n_words", F.size("_words").cast("long"))
    word = lambda i: F.get(F.col("_words"), i)
    windows = F.transform(F.sequence(F.lit(0), F.col("n_words").cast("int") - WINDOW), lambda i: F.xxhash64(*[word(i + k) for k in range(WINDOW)]))
    d = d.withColumn("_windows", F.when(F.col("n_words") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("_repeats", F.size(F.array_distinct("_windows")) < F.size("_windows"))
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_placed", F.when(F.col("_repeats"), placed))
    at = lambda i: F.get(F.col("_placed"), i)["h"]
    again = F.filter("_placed", lambda p, i: p["h"].eqNullSafe(at(i - 1)) | p["h"].eqNullSafe(at(i + 1)))
    d = d.withColumn("_again", F.when(F.col("_repeats"), F.sort_array(F.transform(again, lambda p: p["i"]))))
    covered = F.aggregate(
        F.transform("_again", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(p - F.get(F.col("_again"), j - 1), F.lit(WINDOW)))),
        F.lit(0), lambda a, x: a + x,
    )
    same = F.filter("_words", lambda w, i: w.eqNullSafe(F.get(F.col("_words"), i - 1)))
    counted = {
        "word_chars": _without(F.col("_t"), BLANKS),
        "n_symbols": F.length("_t") - _without(F.col("_t"), SYMBOLS),
        "n_dup_lines": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "n_repeat_words": F.when(F.col("_repeats"), covered).otherwise(0),
        "n_lines": F.size("_lines"),
        "n_capitals": F.length(F.regexp_replace("_t", r"\P{Lu}+", "")),
        "n_digits": F.length("_t") - _without(F.col("_t"), "0123456789"),
        "n_marks": F.length("_t") - _without(F.col("_t"), "!?.,;:"),
        "n_distinct_words": F.size(F.array_distinct("_words")),
        "n_short_words": F.size(F.filter("_words", lambda w: F.length(w) <= 3)),
        "n_same_neighbours": F.size(same),
    }
    own = [c for c in docs.columns if c not in counted and c != "n_words"]
    return d.select(*own, "n_words", *[c.cast("long").alias(name) for name, c in counted.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Rule:
    """Reject a text when every condition (feature, ``>=`` or ``<``, threshold) holds."""

    conditions: tuple[tuple[str, str, float], ...]

    def holds(self) -> Column:
        of = _features()
        out = F.lit(True)
        for name, sign, value in self.conditions:
            out = out & (of[name] >= value if sign == ">=" else of[name] < value)
        return out

    def __str__(self) -> str:
        return "reject if " + " and ".join(f"{n} {s} {v:.6g}" for n, s, v in self.conditions)


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one expression: the first rule that holds rejects; else keep."""
    out = F.lit(True)
    for rule in reversed(rules):
        out = F.when(rule.holds(), F.lit(False)).otherwise(out)
    return out


def _thresholds(stats: DataFrame, steps: int) -> dict[str, list[float]]:
    """Candidate thresholds: quantiles of each feature among good and among bad texts."""
    at = [(i + 0.5) / steps for i in range(steps)]
    rows = stats.groupBy("bad").agg(*[F.percentile_approx(c, F.lit(at), F.lit(10_000)).alias(n) for n, c in _features().items()]).collect()
    return {n: sorted({v for r in rows for v in (r[n] or []) if v is not None}) for n in FEATURES}


def _bin(value: Column, marks: list[float]) -> Column:
    """How many of the thresholds the value reaches."""
    if not marks:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(float(m)) for m in marks]), lambda t: t <= value))


def _counts(binned: DataFrame) -> dict[tuple[int, int], tuple[int, int]]:
    """(feature, bin) -> (rows, bad rows), in one aggregation."""
    rows = binned.select("bad", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.sum("bad").alias("b")
    ).collect()
    return {(r.f, r.bin): (r.n, r.b) for r in rows}


def _bin_condition(f: int, sign: str, k: int) -> Column:
    b = F.get(F.col("bins"), F.lit(f))
    return b >= k if sign == ">=" else b <= k  # below threshold k


def learn(labelled: DataFrame, most_rules: int = 12, most_conditions: int = 4, steps: int = 40,
          precision: float = 0.98, support: int = 10) -> list[Rule]:
    """Sequential covering on rows with statistics and ``bad`` (1 or 0) and ``doc_id``.

    Two thirds of the rows grow rules, one third prunes them.  A rule grows by the condition
    with the best information gain (FOIL) over all features, thresholds and both signs,
    counted in one aggregation per step, until it covers bad rows only or holds
    ``most_conditions``.  Then conditions are cut from its end while that does not worsen
    its precision on the pruning rows.  It joins the list if it covers ``support`` bad
    growing rows and reaches ``precision`` on both parts; the rows it covers are removed.
    Without rows of both kinds the list is empty.
    """
    marks = _thresholds(labelled, steps)
    bins = F.array(*[_bin(value, marks[name]) for name, value in _features().items()])
    data = stage(labelled.select(bins.alias("bins"), F.col("bad").cast("long").alias("bad"), (F.pmod(F.xxhash64("doc_id"), F.lit(3)) > 0).alias("grow")), "rule-bins")
    rules: list[Rule] = []
    left = data
    while len(rules) < most_rules:
        conditions: list[tuple[int, str, int]] = []
        covered = left.where("grow")
        rows = covered.agg(F.count(F.lit(1)), F.sum("bad")).first()
        n, b = rows[0], rows[1] or 0
        if b < support or b == n:
            break
        while len(conditions) < most_conditions and b < n:
            got = _counts(covered)
            best = None
            for f, name in enumerate(FEATURES):
                size = len(marks[name])
                per = [got.get((f, k), (0, 0)) for k in range(size + 1)]
                for k in range(size + 1):
                    # bin k holds the values from threshold k - 1 up to below threshold k
                    for sign, part in ((">=", per[k:]), ("<", per[: k + 1])):
                        pn, pb = sum(x[0] for x in part), sum(x[1] for x in part)
                        if pb >= support and pn < n:
                            gain = pb * (math.log2(pb / pn) - math.log2(b / n))
                            if best is None or gain > best[0] + 1e-9:
                                best = (gain, f, sign, k, pn, pb)
            if best is None or best[0] <= 1e-9:
                break
            _, f, sign, k, n, b = best
            conditions.append((f, sign, k))
            covered = covered.where(_bin_condition(f, sign, k))
        if not conditions:
            break
        ends = [F.lit(True)]
        for c in conditions:
            ends.append(ends[-1] & _bin_condition(*c))
        sums = left.groupBy("grow").agg(*[F.sum(F.when(e, 1).otherwise(0)).alias(f"n{i}") for i, e in enumerate(ends[1:], 1)],
                                        *[F.sum(F.when(e, F.col("bad")).otherwise(0)).alias(f"b{i}") for i, e in enumerate(ends[1:], 1)]).collect()
        part = {r.grow: r for r in sums}
        worth = lambda i, g: (part[g][f"b{i}"] / part[g][f"n{i}"] if part[g][f"n{i}"] else 1.0) if g in part else 1.0
        size = len(conditions)
        while size > 1 and worth(size - 1, False) >= worth(size, False) and worth(size - 1, True) >= precision:
            size -= 1
        if worth(size, False) < precision or worth(size, True) < precision:
            break
        rules.append(Rule(tuple(
            (FEATURES[f], ">=", marks[FEATURES[f]][k - 1]) if sign == ">=" else (FEATURES[f], "<", marks[FEATURES[f]][k])
            for f, sign, k in conditions[:size]
        )))
        left = left.where(~ends[size])
    return rules


def labelled_statistics(docs: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> DataFrame:
    """Statistics of a bounded, hash-chosen sample of about ``most_labels`` labelled rows,
    with ``bad`` = quality 0, without texts that the base rules already reject."""
    known = labels.where("quality is not null").groupBy("doc_id").agg((1 - F.min("quality")).alias("bad"))
    share = min(1.0, most_labels / max(known.count(), 1))
    chosen = known.where(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")
    return stage(with_statistics(rows).drop("text"), "rule-statistics").where(~base_failed())


def judge(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = (), **learning) -> DataFrame:
    """Judge every row of ``docs`` (``doc_id``, ``text``).

    Returns ``doc_id``, the statistics, ``base_failed`` and ``kept`` (not base_failed, and
    no rule of the list learned from ``labels`` holds), one row per input row.  A null or
    empty text has no words and fails the base rules; rows that repeat get equal verdicts;
    without labels of both kinds only the base rules decide; the columns named in ``carry``
    are returned too, others are ignored; an empty table gives no rows.
    """
    rules = learn(labelled_statistics(docs, labels), **learning)
    # Staged, since a filter on the result would otherwise be pushed into the statistics
    # and make Spark compute them several times over.
    out = stage(with_statistics(docs.select("doc_id", "text", *carry)).drop("text"), "rule-counts")
    return out.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & verdict(rules))
