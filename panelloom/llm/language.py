"""Language-model scores of whole texts from a sharded Elias-Fano trie of trigrams.

Texts are read in batches; each batch numbers its words, and words get corpus-wide numbers
and counts by one join.  A batch then asks every shard for its distinct bigrams and trigrams,
one packed row for each shard, with how often its training texts hold them.  A shard adds the
counts of all batches, builds its part of the trie and answers what each batch asked; the
batch interpolates:

    P1(w) = (c(w) + 1) / (N + V + 1)
    P2(w | v) = (c(v w) + weights[0] P1(w)) / (c(v) + weights[0])
    P3(w | u v) = (c(u v w) + weights[1] P2(w | v)) / (c(u v) + weights[1])

so the probabilities after any two words add up to 1.  The trie keeps logarithms of counts,
joint probabilities but for the factor N, in 16-bit steps of 1/1024 (base 2).

The shard of an n-gram follows from all its words (the last one by blocks of 64), so no
context, however frequent, meets in one place: a shard gets an n-gram once from a batch.  The
number of shards grows with the corpus, and every n-gram of the training texts is kept.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import stage, unstage
from panelloom.llm.eliasfano import Trie
from panelloom.llm.wordsplit import slices, split, text_bytes

_BEGIN, _END, _FIRST = 0, 1, 2  # numbers of the marks around a text; words follow
_STEP = 1024


def pack(*columns: np.ndarray) -> bytes:
    """Whole numbers >= 0, byte plane by byte plane, compressed."""
    out = []
    for x in columns:
        width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
        planes = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :width]
        out += [np.array([len(x), width], "<u8").tobytes(), np.ascontiguousarray(planes.T).tobytes()]
    return zstandard.compress(b"".join(out), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(data), 0, []
    while at < len(data):
        n, width = map(int, np.frombuffer(data, "<u8", 2, at))
        planes = np.frombuffer(data, np.uint8, n * width, at + 16).reshape(width, n)
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :width] = planes.T
        out.append(wide.view("<i8").reshape(n))
        at += 16 + n * width
    return out


def _batches(docs: DataFrame, most_bytes: int) -> DataFrame:
    """One row for each batch of texts: its ids, its words, their training counts, its tokens."""
    id_type = docs.schema["_id"].dataType.simpleString()

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Neighbouring slices together up to the bound."""
        held, size = [], 0
        for part in slices(batches, "_text", most_bytes):
            own = int(text_bytes(part.column("_text"))[1][-1])
            if held and size + own > most_bytes:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
            held.append(part)
            size += own
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for k, batch in enumerate(joined(batches)):
            words, borders = split(batch.column("_text"), lower=True)
            coded = words.dictionary_encode()
            token, sizes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.diff(borders)
            held_out = batch.column("_held").to_numpy(zero_copy_only=False)
            train = np.bincount(token[np.repeat(~held_out, sizes)], minlength=len(coded.dictionary))
            # Frequent words get small numbers, which pack well.
            order = np.argsort(-np.bincount(token, minlength=len(train)), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            dictionary = coded.dictionary.take(pa.array(order)).cast(pa.string())
            row = {
                "batch": pa.array([part << 32 | k]), "ids": pa.array([batch.column("_id").to_pylist()], pa.list_(batch.schema.field("_id").type)),
                "held": pa.array([held_out.tolist()], pa.list_(pa.bool_())),
                "words": pa.ListArray.from_arrays(pa.array([0, len(dictionary)], pa.int32()), dictionary),
                "train": pa.ListArray.from_arrays(pa.array([0, len(train)], pa.int32()), pa.array(train[order])),
                "tokens": pa.array([pack(sizes, place[token])], pa.binary()),
            }
            yield pa.RecordBatch.from_arrays(list(row.values()), names=list(row))

    return docs.mapInArrow(numbered, f"batch long, ids array<{id_type}>, held array<boolean>, words array<string>, train array<long>, tokens binary")


def _vocabulary(batches: DataFrame, n_shards: int) -> DataFrame:
    """(word, number, c) of the training words; frequent ones have small numbers."""
    each = batches.select(F.explode(F.arrays_zip("words", "train")).alias("w")).select("w.words", "w.train").where("train > 0")
    counted = each.groupBy(F.col("words").alias("word")).agg(F.sum("train").alias("c"))
    dealt = counted.withColumn("_shard", F.pmod(F.xxhash64("word"), F.lit(n_shards)))
    place = F.row_number().over(Window.partitionBy("_shard").orderBy(F.col("c").desc(), "word"))
    return dealt.select("word", (F.lit(_FIRST) + (place - 1).cast("long") * n_shards + F.col("_shard")).alias("number"), "c")


def _with_numbers(batches: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Batches with ``known``: (numbers, counts) of their words, 0 for unknown ones, and tokens."""
    each = batches.select("batch", F.posexplode("words").alias("place", "word"))
    found = each.join(vocabulary, "word").select(F.col("batch").alias("of"), "place", "number", "c")
    own = batches.select("batch", "ids", "held", "tokens", F.size("words").alias("n_words"))
    schema = own.drop("n_words").schema.add("known", "binary")

    def with_known(left: pa.Table, right: pa.Table) -> pa.Table:
        number, c = np.zeros((2, left.column("n_words")[0].as_py()), np.int64)
        place = right.column("place").to_numpy()
        number[place], c[place] = right.column("number").to_numpy(), right.column("c").to_numpy()
        known = pa.array([pack(number, c)], pa.binary())
        return left.drop_columns(["n_words"]).append_column("known", known)

    return own.groupBy("batch").cogroup(found.groupBy("of")).applyInArrow(with_known, schema)


class _Grams:
    """Distinct bigrams and trigrams of a batch, in the order in which shards are asked."""

    def __init__(self, tokens: bytes, known: bytes, held: list[bool], n_shards: int):
        self.sizes, place = unpack(tokens)
        self.number, self.c = unpack(known)
        held, sizes, n_words = np.array(held, bool), self.sizes, len(self.number)
        # Each text between its marks; marks stand behind the words.
        borders = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(sizes + 2, out=borders[1:])
        token = np.full(borders[-1], n_words, np.int64)
        inner = np.ones(len(token), bool)
        inner[borders[:-1]] = inner[borders[1:] - 1] = False
        token[inner] = place
        token[borders[1:] - 1] = n_words + 1
        doc = np.repeat(np.arange(len(sizes)), sizes + 2)
        number = np.concatenate([self.number, [_BEGIN, _END]])
        asked = np.concatenate([self.number > 0, [True, True]])[token]
        # Words by number, so that sorted n-grams of a shard pack as small steps.
        by_number = np.argsort(number, kind="stable")
        rank = np.empty(len(number), np.int64)
        rank[by_number] = np.arange(len(number))
        sorted_number, token_rank = number[by_number], rank[token]

        self.at = np.flatnonzero(~np.isin(np.arange(len(token)), borders[:-1]))  # every word and end mark
        self.doc, self.token = doc[self.at], token[self.at]
        two_ok = asked[self.at] & asked[self.at - 1]
        three = self.at - 2 >= borders[self.doc]
        three_ok = two_ok & three & asked[np.maximum(self.at - 2, 0)]
        pair = self.at[two_ok]
        key, pair_of = np.unique(token_rank[pair - 1] * len(number) + token_rank[pair], return_inverse=True)
        bigram = np.full(len(token), -1, np.int64)
        bigram[pair] = pair_of
        left, right = np.divmod(key, len(number))
        triple = self.at[three_ok]
        key3, triple_of = np.unique(bigram[triple - 1] * len(number) + token_rank[triple], return_inverse=True)
        parent, last = np.divmod(key3, len(number))
        self.bigram, self.trigram = bigram[self.at], np.full(len(self.at), -1, np.int64)
        self.trigram[three_ok] = triple_of
        self.context = np.where(three, bigram[self.at - 1], -1)  # the two words before, also of a trigram that is not asked
        self.has_two = three

        trained = ~held[doc]
        n_two = np.bincount(pair_of[trained[pair]], minlength=len(key))
        n_three = np.bincount(triple_of[trained[triple]], minlength=len(key3))
        none = np.full(len(key), -1, np.int64)
        grams = np.concatenate([
            np.column_stack([sorted_number[left], sorted_number[right], none]),
            np.column_stack([sorted_number[left[parent]], sorted_number[right[parent]], sorted_number[last]]),
        ])
        last_word = np.where(grams[:, 2] < 0, grams[:, 1], grams[:, 2])
        other = np.where(grams[:, 2] < 0, -1, grams[:, 1])
        h = (grams[:, 0] * -7046029254386353131 + other * -4658895280553007687 + (last_word >> 6)).astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        # Sixteen bits, where they do, are sorted by their digits.
        shard = ((h ^ (h >> np.uint64(31))) % np.uint64(n_shards)).astype(np.uint16 if n_shards <= 1 << 16 else np.int64)
        self.order = np.argsort(shard, kind="stable")  # by words within a shard, bigrams first
        self.borders = np.searchsorted(shard[self.order], np.arange(n_shards + 1))
        self.grams, self.counts, self.n_bigrams = grams, np.concatenate([n_two, n_three]), len(key)

    def asks(self) -> Iterator[tuple[int, bytes]]:
        for shard in np.flatnonzero(np.diff(self.borders)):
            rows = self.order[self.borders[shard] : self.borders[shard + 1]]
            yield int(shard), pack(*_steps(self.grams[rows]), self.counts[rows])


def _steps(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with bigrams first, each part sorted: the first word as steps, -1 as 0."""
    first = grams[:, 0].copy()
    cut = int(np.searchsorted(grams[:, 2] >= 0, True))
    for part in (slice(0, cut), slice(cut, None)):
        first[part] = np.diff(first[part], prepend=0)
    return first, grams[:, 1], grams[:, 2] + 1


def _unsteps(first: np.ndarray, second: np.ndarray, third: np.ndarray) -> np.ndarray:
    cut = int(np.searchsorted(third > 0, True))
    return np.column_stack([np.concatenate([np.cumsum(first[:cut]), np.cumsum(first[cut:])]), second, third - 1])


def _side_by_side(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of n-grams by their words, and where a new one begins in it."""
    new = np.ones(len(grams), bool)
    widths = [int(x).bit_length() for x in grams.max(axis=0) + 1]
    if sum(widths) < 64:  # one number for an n-gram sorts faster than three
        key = (grams[:, 0] << widths[1] | grams[:, 1]) << widths[2] | (grams[:, 2] + 1)
        order = np.argsort(key)
        key = key[order]
        new[1:] = key[1:] != key[:-1]
        return order, new
    pair = (grams[:, 0] << 32 | grams[:, 1],) if grams[:, :2].max() < 1 << 31 else (grams[:, 1], grams[:, 0])
    order = np.lexsort((grams[:, 2], *pair))
    new[1:] = (grams[order[1:]] != grams[order[:-1]]).any(axis=1)
    return order, new


def _answers(asked: DataFrame) -> DataFrame:
    """(of: the batch, shard, codes): what the shard's trie says to each batch's n-grams."""

    def answer(table: pa.Table) -> pa.Table:
        grams, counts, sizes = [], [], []
        for blob in table.column("asks"):
            *packed, n = unpack(blob.as_py())
            grams.append(_unsteps(*packed))
            counts.append(n)
            sizes.append(len(n))
        grams, counts = np.concatenate(grams), np.concatenate(counts)
        order, new = _side_by_side(grams)
        total, own = np.add.reduceat(counts[order], np.flatnonzero(new)), grams[order[new]]
        trained = total > 0
        code = 1 + np.rint(_STEP * np.log2(total[trained])).astype(np.int64)
        with tempfile.TemporaryDirectory() as folder:
            found = Trie(own[trained], code).mapped(folder).find(own).astype(np.int64)
        codes = np.empty(len(grams), np.int64)
        codes[order] = found[np.cumsum(new) - 1]
        parts = np.split(codes, np.cumsum(sizes)[:-1])
        return pa.table({"of": table.column("batch"), "shard": table.column("shard"), "codes": pa.array([pack(x) for x in parts], pa.binary())})

    return asked.groupBy("shard").applyInArrow(answer, "of long, shard int, codes binary")


def score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", weights: tuple[float, float] = (2000.0, 5.0),
          batch_bytes: int = 8 << 20, shard_tokens: int = 1 << 19) -> DataFrame:
    """Rows (id, held_out, n_tokens, n_known, train_tokens, base_score, score), one for each row of ``docs``.

    Tokens are the words, A-Z lower-cased, and one end.  Learns from rows where ``held_out`` is
    false (null counts as false).  ``base_score`` is the sum of log10((c + 1) / (N + V + 1)),
    ``score`` the trigram model's log10 probability, both of the whole text.  A null or empty
    text is its end alone; repeated rows and null ids are scored, and counted, each; other
    columns are ignored; an empty table gives no rows; without training rows N = V = 0 and
    every probability is 1.  A text of any length is one row; one longer than ``batch_bytes``
    is a batch of its own.
    """
    spark = docs.sparkSession
    named = docs.select(docs[id_col].alias("_id"), docs[text_col].cast("string").alias("_text"), F.coalesce(held_out, F.lit(False)).alias("_held"))
    batches = stage(_batches(named, batch_bytes), "language-batches")
    texts, trained, tokens = batches.agg(
        F.sum(F.size("ids")), F.sum(F.size(F.filter("held", lambda h: ~h))), F.sum(F.aggregate("train", F.lit(0).cast("long"), lambda a, x: a + x)),
    ).first()
    id_type = docs.schema[id_col].dataType.simpleString()
    out_schema = f"{id_col} {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    if not texts:
        return spark.createDataFrame([], out_schema)
    n_shards = max(64, -(-2 * tokens // shard_tokens))
    vocabulary = stage(_vocabulary(batches, n_shards), "language-words")
    n, v = tokens + trained, vocabulary.count() + (trained > 0)
    state = stage(_with_numbers(batches, vocabulary), "language-state")
    unstage(batches)

    def ask(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for many in rows:
            for row in many.to_pylist():
                asks = list(_Grams(row["tokens"], row["known"], row["held"], n_shards).asks())
                for start in range(0, len(asks), 256):
                    shard, blob = zip(*asks[start : start + 256], strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array([row["batch"]] * len(shard)), pa.array(shard, pa.int32()), pa.array(blob, pa.binary())], names=["batch", "shard", "asks"])

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        grams = _Grams(row["tokens"], row["known"], row["held"], n_shards)
        count = np.zeros(len(grams.counts))
        for shard, blob in zip(right.column("shard").to_pylist(), right.column("codes"), strict=True):
            code = unpack(blob.as_py())[0]
            count[grams.order[grams.borders[shard] : grams.borders[shard + 1]]] = np.where(code > 0, np.rint(np.exp2((code - 1) / _STEP)), 0)
        two, three = np.append(count[: grams.n_bigrams], 0), np.append(count[grams.n_bigrams :], 0)  # -1: none
        c = np.concatenate([grams.c, [trained, trained]])
        before = np.where(grams.has_two, np.concatenate([[0], grams.token[:-1]]), len(grams.c))
        p1 = (c[grams.token] + 1) / (n + v + 1)
        p2 = (two[grams.bigram] + weights[0] * p1) / (c[before] + weights[0])
        p3 = np.where(grams.has_two, (three[grams.trigram] + weights[1] * p2) / (two[grams.context] + weights[1]), p2)
        texts, known = len(grams.sizes), c[grams.token] > 0
        per_text = lambda x: np.bincount(grams.doc, x, texts)
        return pa.table({
            id_col: pa.array(row["ids"], left.schema.field("ids").type.value_type), "held_out": pa.array(row["held"], pa.bool_()), "n_tokens": pa.array(grams.sizes + 1),
            "n_known": pa.array(per_text(known).astype(np.int64)), "train_tokens": pa.array(np.full(texts, n)),
            "base_score": pa.array(per_text(np.log10(p1))), "score": pa.array(per_text(np.log10(p3))),
        })

    asked = state.mapInArrow(ask, "batch long, shard int, asks binary")
    return state.groupBy("batch").cogroup(_answers(asked).groupBy("of")).applyInArrow(summed, out_schema)
