"""Trigram scores, ranked search and runs of words against brute force; odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelloom.llm import language, runs, search
from panelloom.llm.common import id_crc
from panelloom.llm.eliasfano import EliasFano, Trie
from panelloom.llm.queries import ORACLES, QUERIES
from panelloom.llm.wordsplit import NOT_BLANK, TERM, slices, split
from tests.llm.conftest import ODD, documents, prose
from tools.check import compare, connect

import pyarrow as pa

FOLDER = "/root/testdata/sf0.001"
WORD, TERMS = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=" \n\t\x00aBz9_é\xa0　𝔘")), max_size=6))
def test_words_of_a_column(texts):
    column = pa.array(["cut away", *texts], pa.string()).slice(1)
    for pattern, table in ((WORD, NOT_BLANK), (TERMS, TERM)):
        words, borders = split(column, table, lower=True)
        want = [pattern.findall((t or "").translate(SMALL)) for t in texts]
        assert [words[a:b].to_pylist() for a, b in zip(borders, borders[1:])] == want
    batch = pa.record_batch({"_text": column})
    assert [x for b in slices(iter([batch]), "_text", 3) for x in b.column(0).to_pylist()] == texts


# -- Elias-Fano ---------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**45), max_size=80), st.lists(st.integers(0, 2**46), min_size=1, max_size=20))
def test_successor_search(values, asked):
    values = np.sort(np.array(values, np.int64))
    own = EliasFano.build(values)
    assert own.access(np.arange(len(values))).tolist() == values.tolist()
    asked = np.array([*asked, *values, *(values + 1)], np.int64)
    at, hit = own.successor(asked)
    assert at.tolist() == np.searchsorted(values, asked).tolist() and hit.tolist() == np.isin(asked, values).tolist()


@pytest.mark.parametrize("words", [2, 40, 10**9])
def test_trie_knows_its_grams_and_no_others(words, tmp_path):
    g = np.random.default_rng(words)
    grams = g.integers(0, words, (3000, 3))
    grams[:900, 2] = -1
    grams = np.unique(grams, axis=0)
    codes = g.integers(1, 65000, len(grams))
    known = {tuple(x): c for x, c in zip(grams.tolist(), codes.tolist())}
    asked = np.concatenate([grams, g.integers(0, words, (500, 3)), np.c_[g.integers(0, words, (500, 2)), np.full(500, -1)]])
    assert Trie(grams, codes).mapped(tmp_path).find(asked).tolist() == [known.get(tuple(x), 0) for x in asked.tolist()]


def test_packed_numbers_come_back():
    parts = [np.arange(0), np.array([0, 1, 2**40]), np.arange(300)]
    assert [x.tolist() for x in language.unpack(language.pack(*parts))] == [x.tolist() for x in parts]


def test_equal_ngrams_stand_side_by_side():
    g = np.random.default_rng(4)
    for top in (9, 1 << 20, 1 << 30, 1 << 40):  # one number, three numbers, wide ones
        grams = np.column_stack([g.integers(0, top, 4000), g.integers(0, top, 4000), g.integers(-1, top, 4000)])
        grams = np.concatenate([grams, grams[:1500]])
        order, new = language._side_by_side(grams)
        assert sorted(order.tolist()) == list(range(len(grams)))
        assert list(map(tuple, grams[order[new]].tolist())) == sorted(set(map(tuple, grams.tolist())))


# -- language model -----------------------------------------------------------------------

def model(rows, weights):
    """rows: (text, held out).  Scores by dictionaries, and the probability function."""
    texts = [[None, *WORD.findall((t or "").translate(SMALL)), ""] for t, _ in rows]
    one, two, three = Counter(), Counter(), Counter()
    for w, (_, held) in zip(texts, rows):
        if not held:
            one.update(w[1:])
            two.update(zip(w, w[1:]))
            three.update(zip(w, w[1:], w[2:]))
    n, v = sum(one.values()), len(one)
    begun = sum(not held for _, held in rows)
    p1 = lambda w: (one[w] + 1) / (n + v + 1)
    p2 = lambda a, w: (two[a, w] + weights[0] * p1(w)) / ((begun if a is None else one[a]) + weights[0])
    p3 = lambda a, b, w: (three[a, b, w] + weights[1] * p2(b, w)) / (two[a, b] + weights[1])
    score = lambda w: sum(math.log10(p2(None, w[1]) if k == 1 else p3(w[k - 2], w[k - 1], w[k])) for k in range(1, len(w)))
    base = [sum(math.log10(p1(x)) for x in w[1:]) for w in texts]
    return n, [len(w) - 1 for w in texts], [sum(one[x] > 0 for x in w[1:]) for w in texts], base, [score(w) for w in texts], (one, p3)


@pytest.mark.parametrize("batch_bytes,shard_tokens", [(8 << 20, 1 << 19), (2000, 300)])
def test_scores_equal_dictionaries(spark, batch_bytes, shard_tokens):
    rows = [*ODD, *[(100 + i, prose(i, 40) + " alpha beta " * (i % 5)) for i in range(40)]]
    got = language.score(documents(spark, rows), id_crc() % 7 == 2, weights=(3.0, 2.0), batch_bytes=batch_bytes, shard_tokens=shard_tokens).collect()
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    n, sizes, known, base, score, (one, p3) = model([(t, h) for (_, t), h in zip(rows, held)], (3.0, 2.0))
    key = lambda r: (r[0] is not None, r[0] or 0, *r[1:])
    want = sorted(((i, h, s, k, n, round(b, 5), round(x, 4)) for (i, _), h, s, k, b, x in zip(rows, held, sizes, known, base, score)), key=key)
    assert sorted(((*r[:5], round(r[5], 5), round(r[6], 4)) for r in got), key=key) == want
    for context in (("alpha", "beta"), ("not", "seen"), (None, "alpha")):
        assert abs(sum(p3(*context, w) for w in [*one, "unseen"]) - 1) < 1e-9


def test_scores_without_rows_or_training(spark, nothing):
    assert language.score(nothing, F.lit(False)).count() == 0
    got = language.score(documents(spark, [(1, "a b"), (2, None)]), F.lit(True)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, True, 3, 0, 0, 0.0, 0.0), (2, True, 1, 0, 0, 0.0, 0.0)]


# -- search -------------------------------------------------------------------------------

def ranked(rows, items, k):
    docs = [(i, Counter(TERMS.findall((t or "").translate(SMALL)))) for i, t in rows]
    n, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    out = []
    for item, text in items:
        hits = []
        for i, c in docs:
            m = 50 + 50 * sum(c.values()) * n // max(total, 1)
            s = 0
            for term in set(TERMS.findall((text or "").translate(SMALL))):
                if c[term]:
                    df = sum(term in x for _, x in docs)
                    s += math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) * (10**9 * c[term] // (1000 * c[term] + 20 * m))
            if s:
                hits.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(hits, key=lambda h: (h[0], h[1], h[2] or 0))[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("tiles", [{}, {"most_items": 3, "doc_tile": 5, "term_tile": 2, "item_tile": 2}, {"most_pairs": 1}])
def test_ranking_equals_brute_force(spark, tiles):
    rows = [*ODD, *[(100 + i, prose(i % 7, 30)) for i in range(60)]]  # seven texts, many ties
    items = [(1, prose(1, 8)), (2, None), (3, ""), (4, "Same TEXT row one"), (5, "nowhere-found"), (6, prose(3, 30)), (7, "x" * 5000 + " B"), (8, prose(5, 2))]
    got = search.rank(documents(spark, rows), spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int"), k=6, **tiles).collect()
    key = lambda r: (r[0], r[1])
    assert sorted((tuple(r) for r in got), key=key) == sorted(ranked(rows, items, 6), key=key)


def test_ranking_without_rows(spark, odd, nothing):
    items = spark.createDataFrame([(1, "alpha same")], "item_id long, text string")
    assert search.rank(nothing, items).count() == 0
    assert search.rank(odd, items.limit(0)).count() == 0
    assert {(r.doc_id, r.rank) for r in search.rank(odd, items.unionAll(items), k=1).collect()} == {(5, 1)}


# -- runs ---------------------------------------------------------------------------------

def brute_runs(w):
    out = []
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            end = j + q
            if end - i >= max(6, 4 * q) and not any(all(w[t] == w[t + p] for t in range(i, end - p)) for p in range(1, q)):
                out.append((i, end, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=25), st.integers(1, 9), st.integers(0, 8), st.lists(st.integers(0, 2), max_size=5)), max_size=5))
def test_runs_equal_brute_force(parts):
    texts = [a + a[-p:] * k + b for a, p, k, b in parts]
    borders = np.cumsum([0, *map(len, texts)])
    got = runs.find_runs(np.array([x for t in texts for x in t], np.int64), borders)
    assert [tuple(map(int, r)) for r in got] == [(i, *r) for i, t in enumerate(texts) for r in brute_runs(t)]


def test_one_word_many_times_and_fibonacci_words():
    assert runs.find_runs(np.zeros(100_000, np.int64), np.array([0, 100_000])).tolist() == [[0, 0, 100_000, 1]]
    a, b = [0], [0, 1]
    while len(b) < 200:
        a, b = b, b + a
    text = b + b + b + b + b
    assert [tuple(r[1:]) for r in runs.find_runs(np.array(text), np.array([0, len(text)])).tolist()] == brute_runs(text)


def planted(i, words):
    h = zlib.crc32(b"" if i is None else str(i).encode())
    if h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


def test_report_of_odd_rows(spark, odd, nothing):
    rows = [*ODD, *[(1000 + i, prose(i, 90)) for i in range(60)], (3000, "a b c " * 400), (3001, "go " * 7 + "on " * 6 + "x y " * 5)]
    got = runs.report(documents(spark, rows), plant=True).collect()
    want = []
    for i, t in rows:
        w = planted(i, WORD.findall(t or ""))
        found = brute_runs(w)
        best = max(((e - s, -s, -q) for s, e, q in found), default=None)
        dropped = {k for s, e, q in found for k in range(s + q, e)}
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        longest = (-best[1], best[0], -best[2], 1000 * best[0] // -best[2]) if best else (None,) * 4
        want.append((i, len(found), *longest, digest("".join(f"{s},{e - s},{q}\n" for s, e, q in found)), digest(" ".join(x for k, x in enumerate(w) if k not in dropped))))
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    assert sorted((tuple(r)[:8] for r in got), key=key) == sorted(want, key=key)
    assert sum(r.n_runs > 0 for r in got) > 5
    assert runs.report(nothing).count() == 0


# -- registered queries -------------------------------------------------------------------

def test_registered_search_equals_its_sql(spark):
    df, want = QUERIES["op12_blocked_search"](spark, FOLDER), connect(FOLDER).execute(ORACLES["op12_blocked_search"])
    status = compare(df.columns, [tuple(r) for r in df.collect()], [d[0] for d in want.description], want.fetchall())
    assert status.startswith("ok"), status
    assert [t for _, t in df.dtypes] == ["bigint", "int", "bigint", "bigint"]


def test_registered_scores_and_runs(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    scores = QUERIES["op11_trie_scores"](spark, FOLDER)
    assert scores.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("n_tokens", "bigint"), ("n_known", "bigint"), ("train_tokens", "bigint"), ("base_score", "double"), ("score", "double")]
    got = {r.doc_id: r for r in scores.collect()}
    held = {d.doc_id: zlib.crc32(str(d.doc_id).encode()) % 7 == 2 for d in docs}
    n, sizes, known, base, score, _ = model([(d.text, held[d.doc_id]) for d in docs], (2000.0, 5.0))
    for d, s, k, b, x in zip(docs, sizes, known, base, score):
        r = got[d.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d.doc_id], s, k, n)
        assert abs(r.base_score - b) < 1e-6 * max(1, -b) and abs(r.score - x) < 1e-3 * max(1, -x)
    out = sum(r.score for r in got.values() if r.held_out), sum(r.base_score for r in got.values() if r.held_out)
    assert out[0] > 0.95 * out[1]
    found = QUERIES["op13_square_runs"](spark, FOLDER).collect()
    assert len(found) == len(docs)
    texts = {d.doc_id: planted(d.doc_id, WORD.findall(d.text or "")) for d in docs if len(d.text or "") < 3000}
    assert all(r.n_runs == len(brute_runs(texts[r.doc_id])) for r in found if r.doc_id in texts)
