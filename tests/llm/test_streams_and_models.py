"""Packing, sharding, mixing, token files, classifiers, pipeline: odd rows, brute force, round trips."""

import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from panelloom.llm import compression, mixing, packing, sharding, tokenfile, toxicity
from panelloom.llm.queries import QUERIES, vocabulary
from panelloom.llm.tokens import encoder
from tests.llm.conftest import ODD, documents, prose


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(vocabulary())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'1!é\xa0　s\0𝔘<|endoftext|>.tTlL\u2028"), max_size=4))
def test_ids_equal_the_library(texts):
    own = Tokenizer.from_file(vocabulary())
    own.encode_special_tokens = True
    want = [own.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u2").tolist() for x in encoder(vocabulary()).encode(texts)] == want


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 400), min_size=1, max_size=700), min_size=1, max_size=5))
def test_blocks_round_trip(blocks):
    blocks = [np.array(b, "<u2") for b in blocks]
    frames = tokenfile.encode_blocks(blocks, 401)
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(blocks, tokenfile.decode_blocks(frames)))


def test_damaged_block_is_refused_and_prediction_pays():
    ids = np.tile(np.arange(50, dtype="<u2"), 60)
    frame = tokenfile.encode_blocks([ids], 50257)[0]
    assert len(frame) < len(ids) // 4
    with pytest.raises(ValueError):
        tokenfile.decode_blocks([frame[:40] + bytes([frame[40] ^ 1]) + frame[41:]])
    with pytest.raises(ValueError):
        tokenfile.decode_blocks([b"XXXX" + frame[4:]])


@given(st.binary(max_size=50), st.binary(max_size=50))
def test_crc_of_joined_runs(a, b):
    assert tokenfile.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_token_file_of_odd_rows(spark, odd, nothing, plain, tmp_path):
    path = f"file://{tmp_path}/tokens"
    tokenfile.write(odd, vocabulary(), path)
    out = tokenfile.documents(tokenfile.read(spark, path, odd.schema["doc_id"].dataType), path).orderBy("start").collect()
    rows = sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    at = 0
    for r, (i, t) in zip(out, rows, strict=True):
        ids = [*plain(t), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    tokenfile.write(nothing, vocabulary(), path + "0")
    assert tokenfile.documents(tokenfile.read(spark, path + "0", odd.schema["doc_id"].dataType), path + "0").count() == 0


def test_packing_of_odd_rows(spark, odd, nothing, plain):
    out = packing.pack(odd, vocabulary(), length=256).collect()
    fill = {}
    for r in sorted(out, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0) and len(r.ids) == 4 * r.length
        fill[r.sequence_id] = r.offset + r.length
    assert all(n == 256 or n & (n - 1) == 0 for n in fill.values())
    assert sum(fill.values()) == sum(len(plain(t)) + 1 for _, t in ODD)
    for i, t in ODD:
        if i in (1, 2, 4, 8, 9, 10):
            pieces = sorted((r for r in out if r.doc_id == i), key=lambda r: r.start)
            assert b"".join(r.ids for r in pieces) == np.array([*plain(t), 1], "<u4").tobytes()
    assert packing.pack(nothing, vocabulary()).count() == 0


@pytest.mark.parametrize(("dims", "bits"), [(2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_neighbours(dims, bits):
    cells = np.indices([1 << bits] * dims).reshape(dims, -1).T
    key = packing.hilbert_key(cells, bits)
    assert sorted(key) == list(range(len(key)))
    assert (np.abs(np.diff(cells[np.argsort(key)], axis=0)).sum(axis=1) == 1).all()


def test_shards_are_near_equal_and_copies_stay_together(spark):
    rows = [(i, prose(i, 30 + i % 40)) for i in range(1200)] + [(5000 + i, "hot copy " * 30) for i in range(600)]
    out = sharding.shard(documents(spark, rows), shards=8).select("doc.doc_id", "doc.text", "size", "shard", "slot").collect()
    assert sorted(r.doc_id for r in out) == sorted(i for i, _ in rows)
    size, slots, where = [0] * 8, {}, {}
    for r in out:
        assert r.size == len(r.text.encode()) + 1
        size[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
        where.setdefault(r.text, set()).add(r.shard)
    assert max(size) - min(size) <= 0.03 * sum(size) / 8 + 2 * max(r.size for r in out)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(w) == 1 for t, w in where.items() if not t.startswith("hot"))


def test_sharding_of_odd_rows(spark, odd, nothing):
    out = sharding.shard(odd, shards=4)
    assert out.count() == len(ODD) and set(out.select("doc.*").columns) == set(odd.columns)
    assert out.where("doc.text is null and size != 1").count() == 0
    assert sharding.shard(nothing, shards=4).count() == 0


def test_mixture_takes_its_targets(spark):
    rows = [(i, prose(i, 20 + i % 50), "big" if i % 3 else f"s{i % 4}") for i in range(400)] + [(900, "few words here", "tiny"), (901, None, None), (902, "null source words", None)]
    out = mixing.mix(documents(spark, rows)).collect()
    words = {}
    for i, t, s in rows:
        words[s] = words.get(s, 0) + len((t or "").split())
    names = sorted((s for s in words if s is not None)) + [None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, left, free = {}, 1.5 * sum(words.values()), set(names)
    while True:  # the excess is shared again until none is above its cap
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * words[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * words[s]
            left -= target[s]
        free -= over
    target.update(share)
    for s in names:
        own = [r for r in out if r.source == s]
        assert all(abs(r.target - target[s]) < 1e-6 * max(target[s], 1) and r.source_size == words[s] for r in own)
        assert abs(sum(r.taken for r in own) - target[s]) <= 0.51
        assert all(0 <= r.taken <= 2 * r.size and r.taken == sum(r.takes) for r in own)
    again = {r.doc_id: r.taken for r in mixing.mix(documents(spark, rows[::-1])).collect()}
    assert again == {r.doc_id: r.taken for r in out}


def test_schedule_is_even(spark):
    got = mixing.slots([600, 300, 100], 10, spark).where("slot < 100").collect()
    for s, share in enumerate((60, 30, 10)):
        own = sorted((r.slot, r.rank) for r in got if r.s == s)
        assert [rank for _, rank in own] == list(range(len(own))) and abs(len(own) - share) <= 3


def test_mixing_of_odd_rows(spark, odd, nothing):
    out = mixing.mix(odd)
    assert out.count() == len(ODD) and out.where("taken > 2 * size").count() == 0
    assert mixing.mix(nothing).count() == 0


def test_mixture_rows_follow_the_schedule(spark, tmp_path):
    """Every stretch of the mixture holds the sources near their share, small sources too."""
    rows = [(i, prose(i, 20 + i % 50), "abc"[i % 3 and 1 + (i % 5 == 0)]) for i in range(600)]
    out = corpus_pipeline.source_mixing(spark, documents(spark, rows), str(tmp_path)).collect()
    size = lambda part, s: sum(len(r.text.split()) for r in part if r.source == s)
    whole = sum(size(out, s) for s in "abc")
    for part in (out[: len(out) // 4], out[: len(out) // 2], out[len(out) // 2 :]):
        total = sum(size(part, s) for s in "abc")
        assert all(abs(size(part, s) / total - size(out, s) / whole) < 0.1 for s in "abc")


def test_compression_separates_planted_classes(spark, odd, nothing):
    rows = [(i, prose(i, 80)) for i in range(300)] + [(i, " ".join(w.upper() + "!!" for w in prose(i, 80).split())) for i in range(300, 400)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i < 300)) for i in range(400)], "doc_id long, quality int")
    model = compression.train(docs, labels.where("doc_id % 2 = 0"))
    out = {r.doc_id: r for r in compression.classify(docs, model).collect()}
    assert np.mean([out[i].predicted == (i < 300) for i in range(1, 400, 2)]) > 0.97
    odd_out = compression.classify(odd, model).collect()
    assert len(odd_out) == len(ODD) and all(0 <= r.score <= 1 for r in odd_out)
    assert compression.train(docs, labels.where("quality = 1")) is None
    assert compression.classify(nothing, model).count() == 0 and compression.classify(odd, None).where("score = 1").count() == len(ODD)


def test_toxicity_finds_held_out_insults(spark, odd, nothing):
    bad = ["dolt", "wretch", "oaf"]

    def text(i, toxic):
        w = prose(i, 60).split()
        for k in range(3 * toxic):
            w[(i * 7 + 13 * k) % 60] = bad[(i + k) % 3] + ("" if i % 2 else "ish")
        return " ".join(w)

    rows = [(i, text(i, i % 5 == 0)) for i in range(500)]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels.where("doc_id < 350"), rounds=5)
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert np.mean([out[i].predicted == (i % 5 == 0) for i in range(350, 500)]) > 0.95
    odd_out = toxicity.score(odd, model).collect()
    assert len(odd_out) == len(ODD) and all(0 <= r.score <= 1 for r in odd_out)
    assert toxicity.score(nothing, model).count() == 0 and toxicity.train(docs, labels.where("toxic = 0")) is None


def test_hidden_spellings_count():
    lexicon = toxicity.Lexicon({"moron": 5.0, "idio*": 4.0})
    at = {n: i for i, n in enumerate(toxicity.FEATURES)}
    f = toxicity.features_of("you m0r0n and i d i o t YOU MORON", lexicon)
    assert f[at["hidden_hits"]] == 2 and f[at["capital_hits"]] == 1 and f[at["near_you_per_100"]] > 0
    assert toxicity.features_of(None, lexicon) == toxicity.features_of("", lexicon)


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept, names = docs, [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "quality_rules", "near_dedup", "source_mixing", "curve_packing"]
    for name, step in corpus_pipeline.STAGES:
        before = kept
        kept = step(spark, before, folder).cache()
        if name != "curve_packing":
            assert kept.columns == docs.columns
        if name in ("quality_classifier", "quality_rules", "near_dedup"):
            assert 0 < kept.count() <= before.count() and kept.exceptAll(before).count() == 0
    assert kept.select("doc_id").distinct().count() > 0


def test_pipeline_stages_on_odd_rows(spark, odd, nothing, tmp_path):
    folder = str(tmp_path)
    spark.createDataFrame([(1, 0, 0), (8, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    for docs in (odd, nothing):
        for _, step in corpus_pipeline.STAGES:
            step(spark, docs, folder).collect()
    mixed = corpus_pipeline.source_mixing(spark, odd, folder).collect()
    plan = {}
    for r in mixing.mix(odd).collect():
        plan[r.doc_id] = plan.get(r.doc_id, 0) + r.taken
    words = {}
    for r in mixed:
        words[r.doc_id] = words.get(r.doc_id, 0) + len((r.text or "").split())
    assert all(words.get(i, 0) == n for i, n in plan.items() if i in (4, 5, 8, 11))


def test_queries_are_registered():
    assert [int(q[2:].split("_")[0]) for q in QUERIES] == list(range(1, 14))


def test_pipeline_decides_by_row_not_by_id(spark, odd, tmp_path):
    folder, short = str(tmp_path), "too short"
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    of = lambda df: sorted((str(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())
    # rules: a text stays by itself, whatever else stands under its id or without one
    rows = [(7, prose(1, 60)), (7, short), (None, prose(2, 60)), (None, prose(3, 60)), (None, short), (9, short)]
    assert of(corpus_pipeline.quality_rules(spark, documents(spark, rows), folder)) == sorted((str(i), t) for i, t in rows if t != short)
    # near duplicates: rows without an id all stay, and so do unlike texts under one id
    gone = [(6, "same text here"), (7, prose(1, 300)), (12, "Same Text HERE")]
    want = list(ODD)
    for row in gone:
        want.remove(row)
    assert of(corpus_pipeline.near_dedup(spark, odd, folder)) == sorted((str(i), t or "") for i, t in want)
    near = [(7, prose(1, 300)), (7, prose(1, 300) + " end"), (7, prose(4, 90)), (3, prose(4, 90) + " end"), (None, prose(1, 300)), (None, prose(1, 300))]
    left = of(corpus_pipeline.near_dedup(spark, documents(spark, near), folder))
    assert [i for i, _ in left] == ["3", "7", "None", "None"] and left[1][1].startswith(prose(1, 300))


def test_mixture_of_repeated_and_missing_ids(spark, odd):
    repeats = [(7, prose(1, 50), "a")] * 3 + [(7, prose(2, 50), "a"), (7, prose(1, 50), "b"), (None, prose(3, 50), "a"), (None, prose(4, 50), "a"), (None, prose(3, 50), "b")]
    for docs in (documents(spark, repeats), odd):
        plan, got = {}, {}
        for r in mixing.mix(docs).collect():
            key = (r.doc_id, r.source)
            plan[key] = (plan.get(key, (0, 0))[0] + sum(t > 0 for t in r.takes), plan.get(key, (0, 0))[1] + r.taken)
        for r in corpus_pipeline.source_mixing(spark, docs, "").collect():
            key = (r.doc_id, r.source)
            got[key] = (got.get(key, (0, 0))[0] + 1, got.get(key, (0, 0))[1] + len(re.findall(r"[^ \t-\r]+", r.text or "")))
        assert got == {k: v for k, v in plan.items() if v[0]}


def test_joining_checksums_squares_no_matrix_twice(monkeypatch):
    a, b = bytes(range(64)), bytes(16384)
    tokenfile.join_crc(zlib.crc32(a), zlib.crc32(b), len(b))
    calls, times = [], tokenfile._times
    monkeypatch.setattr(tokenfile, "_times", lambda m, v: calls.append(1) or times(m, v))
    assert tokenfile.join_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert len(calls) <= 32
