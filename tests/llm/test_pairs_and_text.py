"""De-duplication, fingerprints, rules, page text: odd rows and brute force."""

import hashlib
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelloom.llm import dedup, fingerprint, html, rules
from tests.llm.conftest import ODD, documents, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, x in sets:
        for b, y in sets:
            if a < b and x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets}


def test_components_match_brute_force_with_a_large_group_of_near_copies(spark):
    g = np.random.default_rng(3)
    base = prose(9, 120).split()
    rows = [(i, prose(100 + i, 40)) for i in range(30)]
    for i in range(30, 400):  # one group, changed so much that many copies are no links of each other
        w = list(base)
        for at in g.choice(120, int(g.integers(0, 7)), replace=False):
            w[at] = f"changed{g.integers(1000)}"
        rows.append((i, " ".join(w)))
    rows += [(500, rows[0][1]), (501, rows[0][1].upper()), (502, "a b c"), (503, "A  b\nc"), (504, "a b")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(documents(spark, rows)).collect()}
    assert got == components(rows)


def test_blocks_find_the_links_that_the_centres_miss(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK", 4)
    words = [f"w{i}" for i in range(60)]
    rows = [(k, " ".join(words[:5 * k] + [f"n{k}x{j}" for j in range(3)] + words[5 * k + 3 :])) for k in range(8)]
    rows += [(20 + k, " ".join(words[: 50 - 2 * k])) for k in range(8)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in dedup.near_duplicates(documents(spark, rows)).collect()}
    assert got == components(rows)


def test_dedup_of_odd_rows(spark, odd, nothing):
    got = dedup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    by = {r.doc_id: r for r in got}
    assert by[6].component_id == 5 and by[12].component_id == 5 and not by[6].kept
    assert by[2].n_shingles == 0 and by[2].component_id == 2 and by[2].kept
    assert by[None].component_id is None and by[None].kept
    assert dedup.near_duplicates(nothing).count() == 0


def test_signature_values_estimate_similarity(spark):
    a, b = prose(4, 400).split(), prose(4, 400).split()
    b[50:90] = prose(5, 40).split()
    x, y = shingles(" ".join(a)), shingles(" ".join(b))
    hashes, at = dedup.shingle_sets([" ".join(a), " ".join(b)])
    assert [len(x), len(y)] == np.diff(at).tolist()
    s = dedup.signatures(hashes, at)
    assert abs((s[0] == s[1]).mean() - len(x & y) / len(x | y)) < 0.15


def test_fingerprints_of_odd_rows(spark, odd, nothing):
    got = fingerprint.fingerprint(odd).orderBy("doc_id").collect()
    assert len(got) == len(ODD)
    order = sorted(((i, t or "") for i, t in ODD), key=lambda r: (r[0] is not None, r[0] or 0))
    prints = {}
    for r in got:
        for i, t in ODD:
            if i == r.doc_id and len(t or "") == r.n_chars:
                prints.setdefault(t or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for t, v in prints.items() if list(x[1] or "" for x in ODD).count(t))
    by = {r.doc_id: r for r in got}
    for i in (4, 5, 8, 9, 10, 11):
        text = dict(order)[i]
        after = next(t for j, t in order if j == i + 1) if i != 6 else None
        half = len(text) // 2
        assert by[i].edited_sha256 == hashlib.sha256((text[: len(text) - half] + after[:half]).encode()).hexdigest()
    assert by[2].fingerprint == "" and by[5].fingerprint == by[6].fingerprint and by[5].near_next == 1.0
    assert 0.0 < by[8].near_edited < 1.0 and by[10].n_chars == 5000
    assert fingerprint.fingerprint(nothing).count() == 0


def test_next_document_across_blocks(spark):
    rows = [(i * 7 % 101, f"text {i} " + prose(i, 20)) for i in range(101)]
    dealt = fingerprint.with_next(documents(spark, rows), block_rows=10)
    assert dealt.select("block").distinct().count() > 5
    assert dealt.where("not guest").count() == 101
    texts = dict(rows)
    got = fingerprint.fingerprint(documents(spark, rows)).collect()
    for r in got:
        t, n = texts[r.doc_id], texts[(r.doc_id + 1) % 101]
        h = len(t) // 2
        assert r.edited_sha256 == hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest()


def test_fingerprints_heed_order(spark):
    w = prose(8, 200).split()
    moved = w[100:] + w[:100]
    df = spark.createDataFrame([(" ".join(w), " ".join(moved), " ".join(w[:190]))], "a string, b string, c string")
    for c in "abc":
        df = fingerprint.with_signature(df, c, f"s{c}")
    row = df.select(fingerprint.likeness("sa", "sb").alias("moved"), fingerprint.likeness("sa", "sc").alias("cut")).first()
    assert row.cut > row.moved


def counted(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 500 else set()
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def test_statistics_match_brute_force(spark, odd, nothing):
    rows = [(i, t) for i, t in ODD if i != 8] + [(50, "a b c d e " * 3 + "f"), (51, "a a a a a a a"), (52, "x\nx\n y\nx # | <b>"), (53, "p q r s t u v\np q r s t z")]
    out = rules.with_statistics(documents(spark, rows)).collect()
    want = sorted((str(i), *counted(t)) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out) == want
    assert rules.with_statistics(nothing).count() == 0


def test_learned_list_rejects_planted_junk_and_keeps_prose(spark):
    rows = [(i, prose(i, 60)) for i in range(160)] + [(i, " ".join(w + "###" for w in prose(i, 60).split())) for i in range(160, 220)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 160)) for i in range(220)], "doc_id long, quality int")
    out = {r.doc_id: r.kept for r in rules.judge(docs, labels).collect()}
    assert all(out[i] == (i < 160) for i in out) and len(out) == 220
    assert rules.judge(docs, labels.where("quality = 1")).where("kept").count() == 220


def test_judge_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 0), (2, 1), (None, 1)], "doc_id long, quality int")
    out = rules.judge(odd, labels).collect()
    assert len(out) == len(ODD) and not any(r.kept for r in out if r.n_words < 10)
    assert rules.judge(nothing, labels).count() == 0


PAGES = [
    ("<html><body><nav><a href='/a'>Home</a></nav><article><h1>T &amp; U</h1><p>one\n two<p>three<br>four</article><footer>f</footer>", "T & U\none two\nthree\nfour"),
    ("<div class='menu'><a href=x>m</a></div><p>" + "long text " * 12 + "</p><p>end</p><div id=comments><p>" + "reply " * 40 + "</p></div>", ("long text " * 12).strip() + "\nend"),
    ("<script>if (a<b) { x('</p>') }</script><p>kept</p><!-- <p>no</p>", "kept"), ("", ""), (None, ""), ("plain &#x41; &lt;", "plain A <"),
    ("<head><title>t</title><p>body without tag", "body without tag"), ("<form><p>f</p></form>", ""),
]


def test_pages(spark):
    df = spark.createDataFrame([(i, f"u{i}", p, "x") for i, (p, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    got = {r.page_id: (r.text, r.n_chars) for r in html.extract(df).collect()}
    assert got == {i: (t, len(t)) for i, (_, t) in enumerate(PAGES)}
    assert html.extract(df.where("page_id < 0")).count() == 0


def test_line_blocks_find_the_stretch_with_most_text():
    menu = "".join(f"<div><a href='/{i}'>link number {i}</a></div>" for i in range(20))
    story = "".join(f"<div>{'sentence of the story ' * 6}</div><div>short</div>" for _ in range(5))
    text = html.main_text(f"<body>{menu}{story}{menu}</body>")
    assert text.count("short") == 5 and "link number" not in text


def test_line_blocks_keep_the_text_on_both_sides_of_an_insert():
    part = lambda k: "".join(f"<div>{f'part {k} sentence {i} of the story ' * 5}</div>" for i in range(4))
    menu = "".join(f"<div><a href='/{i}'>menu entry {i}</a></div>" for i in range(9))
    advert = "<div class='ad'><p>buy</p><p>more</p><p>of it</p><p>now</p></div>"
    links = "<ul>" + "".join(f"<li><a href='/s{i}'>source {i}</a></li>" for i in range(4)) + "</ul>"
    text = html.main_text(f"<body>{menu}{part(1)}{advert}{part(2)}{links}<p>short</p>{links}{part(3)}{menu}</body>").split("\n")
    assert sum(t.startswith("part") for t in text) == 12 and "short" in text and text.count("source 2") == 2
    assert "buy" not in text and not any(t.startswith("menu") for t in text)


def test_article_elements_do_not_replace_the_line_blocks():
    story = "".join(f"<div>{f'sentence {i} of the story ' * 5}</div>" for i in range(6))
    long = lambda k: f"<p>{f'{k} of some length ' * 8}</p>"
    page = f"<body><article class='teaser'>{long('teaser')}</article>{story}<article class='comment odd' id='comment-7'>{long('reply')}</article></body>"
    text = html.main_text(page).split("\n")
    assert len(text) == 6 and all(t.startswith("sentence") for t in text)
    body = html.main_text(f"<body>{story}<article class='post comments-open has-sidebar'>{long('article')}</article></body>").split("\n")
    assert len(body) == 7 and body[-1].startswith("article")
    # An article as such is no condition: the same page of div elements gives the same text.
    assert html.main_text(f"<nav><p>n</p></nav><article><h1>T</h1>{story}</article><footer>f</footer>") == html.main_text(
        f"<nav><p>n</p></nav><div><h1>T</h1>{story}</div><footer>f</footer>")


def test_all_other_statistics_match_brute_force(spark):
    rows = [(i, t) for i, t in ODD] + [(50, "a b c d e " * 3 + "f"), (51, "a a a a a a a"), (52, "the the cat sat sat sat down!? 12 ÀB"), (53, "Ab ab ab\nab x.y, z;:")]
    out = rules.with_statistics(documents(spark, rows)).collect()

    def others(text):
        text = text or ""
        words = WORD.findall(text)
        return (sum(bool(WORD.search(x)) for x in text.split("\n")), sum(unicodedata.category(c) == "Lu" for c in text), sum(c in "0123456789" for c in text),
                sum(c in "!?.,;:" for c in text), len(set(words)), sum(len(w) <= 3 for w in words), sum(x == y for x, y in zip(words, words[1:])))

    names = ("n_lines", "n_capitals", "n_digits", "n_marks", "n_distinct_words", "n_short_words", "n_same_neighbours")
    assert sorted((str(r.doc_id), *[r[n] for n in names]) for r in out) == sorted((str(i), *others(t)) for i, t in rows)


def test_fingerprints_of_short_texts_heed_order(spark):
    def expected(a, b):
        """Share of the pairs of elements that two permuted texts have in the same order."""
        x, y = ({p: i for i, p in enumerate(zip(w, w[1:]))} for w in (a, b))
        every, both = sorted(x.keys() | y.keys()), x.keys() & y.keys()
        pairs = [(p, q) for i, p in enumerate(every) for q in every[:i]]
        return sum(p in both and q in both and (x[p] < x[q]) == (y[p] < y[q]) for p, q in pairs) / len(pairs)

    rows = []
    for n in (20, 40, 60):
        for seed in range(40):
            w = [f"{x}{i}" for i, x in enumerate(prose(seed, n).split())]
            moved = w[n // 2 :] + w[: n // 2]
            rows.append((n, " ".join(w), " ".join(moved), expected(w, moved)))
    rows += [(1, "one", "one", 1.0), (2, "a b c", "b c a b", 0.0)]
    df = spark.createDataFrame(rows, "n int, a string, b string, want double")
    for c in "ab":
        df = fingerprint.with_signature(df, c, f"s{c}")
    got = df.select("n", "want", fingerprint.likeness("sa", "sb").alias("like"), F.size("sa").alias("bins")).collect()
    assert {r.bins for r in got} == {64} and next(r.like for r in got if r.n == 1) == 1.0
    for n in (20, 40, 60):
        own = [r for r in got if r.n == n]
        assert abs(np.mean([r.like for r in own]) - np.mean([r.want for r in own])) < 0.06


def test_pages_without_names_and_place_tags_give_the_same_text():
    """The window sums, headings and link lengths find the text when no tag or class tells it."""
    import re

    import pyarrow.parquet as pq

    def plain(page):
        page = re.sub(r'\s(?:class|id|role|aria-[a-z]+)\s*=\s*("[^"]*"|\'[^\']*\'|[^\s>]+)', "", page)
        return re.sub(r"<(/?)(nav|header|footer|article|main|aside|section|form)\b", r"<\1div", page)

    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet").column("html").to_pylist()
    same = [html.main_text(plain(p)) == html.main_text(p) != "" for p in pages]
    assert sum(same) >= 0.95 * len(same)


def test_unmarked_header_notice_and_owner_are_left_out():
    long = "A sentence of the article that goes on for a while, as sentences of articles do, and then ends. " * 2
    page = f"<div>My Site Name</div><div>Welcome back, please log in to read on</div><h1>The headline</h1><p>{long}</p><p>Short one.</p><p>{long}</p><div>© 2024 Example</div>"
    assert html.main_text(page) == f"The headline\n{long.strip()}\nShort one.\n{long.strip()}"


def test_unclosed_elements_end_with_their_parent():
    long = "Words of the article that are many enough to be seen as text by the window, surely so, indeed. " * 2
    for tag in ("select", "svg", "object", "canvas", "template", "noscript", "audio", "video"):
        page = f"<body><article><p>{long}</p><div>before <{tag}><b>inside</b></div><p>after {long}</p></article></body>"
        assert html.main_text(page) == f"{long.strip()}\nbefore\nafter {long.strip()}", tag
    assert html.main_text(f"<p>{long}</p><script>var x = 1; {long}") == long.strip()


def test_deep_nesting_and_many_unclosed_take_linear_time():
    import time

    def seconds(n):
        page = "<div>" * n + "text of the page " * 20 + "</div><i></b>" * n + "<svg>" * n
        began = time.perf_counter()
        html.main_text(page)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(40_000) < 20 * max(seconds(5_000), 0.01)
