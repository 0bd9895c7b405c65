"""Ranked lexical search: tiles of item vocabulary times tiles of document impacts.

Items are taken in blocks of bounded size.  For each block one pass over all documents counts
the block's terms (Arrow and NumPy, whole texts) and writes the counts; totals and document
frequencies follow from those.  A second pass multiplies dense float64 tiles: documents x
terms (impacts) with terms x items (weights).  All numbers are whole; a tile has so few terms
that no partial sum reaches 2**53, so BLAS adds exactly in any order, and tiles are summed as
64-bit integers.  Each task keeps the best of every item by (score, document id), so ties are
cut as in the final order; tasks' bests are merged in two steps.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.llm.common import stage
from panelloom.llm.wordsplit import TERM, slices, split

#: Factors of a term's weight and of an impact, and the share of the length in it.
WEIGHT, IMPACT, LENGTH, DAMP = 1000, 1_000_000_000, 50, 20
_EXACT = 2**53
_NO_ID = 2**63 - 1


def _item_blocks(items: DataFrame, item_col: str, text_col: str, most_items: int, most_pairs: int) -> Iterator[tuple[list, list[list[str]]]]:
    """(ids, distinct terms) of the items, read partition by partition, in blocks of at most
    ``most_items`` items and about ``most_pairs`` pairs of item and term."""
    ids, terms, pairs = [], [], 0
    rows = items.select(items[item_col].alias("_id"), items[text_col].cast("string").alias("_text")).toLocalIterator()
    for row in rows:
        words, _ = split(pa.array([row["_text"]], pa.string()), TERM, lower=True)
        found = pc.unique(words).to_pylist()
        if ids and (len(ids) == most_items or pairs + len(found) > most_pairs):
            yield ids, terms
            ids, terms, pairs = [], [], 0
        ids.append(row["_id"])
        terms.append(found)
        pairs += len(found)
    if ids:
        yield ids, terms


def count_terms(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, n, terms, tf): all terms of each text counted, those of the vocabulary by number."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(vocabulary, pa.large_string())
        for batch in slices(batches, "_text"):
            words, borders = split(batch.column("_text"), TERM, lower=True)
            coded = words.dictionary_encode()
            number = pc.index_in(coded.dictionary, known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            term = number[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int64)
            sizes = np.diff(borders)
            doc = np.repeat(np.arange(len(sizes)), sizes)[term >= 0]
            key, tf = np.unique(doc * len(known) + term[term >= 0], return_counts=True)
            at = np.searchsorted(key, np.arange(len(sizes) + 1) * len(known)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(at), pa.array(x)) for x in ((key % max(len(known), 1)).astype(np.int32), tf.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(sizes), *lists], names=["doc_id", "n", "terms", "tf"])

    own = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].cast("string").alias("_text"))
    return own.mapInArrow(counted, "doc_id long, n long, terms array<int>, tf array<long>")


class _Best:
    """The ``k`` best (score, id) of each item so far."""

    def __init__(self, items: int, k: int):
        self.k, self.floor = k, np.zeros(items, np.int64)
        self.rows = np.zeros((3, 0), np.int64)  # item, score, id
        self.fresh: list[np.ndarray] = []

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores``: documents x items.  What ties with the present last place stays in play."""
        doc, item = np.nonzero((scores > 0) & (scores >= self.floor))
        self.fresh.append(np.stack([item, scores[doc, item], ids[doc]]))
        if sum(x.shape[1] for x in self.fresh) > 8 * self.k * len(self.floor):
            self.cut()

    def cut(self) -> np.ndarray:
        rows = np.concatenate([self.rows, *self.fresh], axis=1)
        rows = rows[:, np.lexsort((rows[2], -rows[1], rows[0]))]
        first = np.searchsorted(rows[0], rows[0])
        place = np.arange(rows.shape[1]) - first
        last = rows[:, place == self.k - 1]
        self.floor[last[0]] = last[1]
        self.rows, self.fresh = rows[:, place < self.k], []
        return self.rows


def _scored(counts: DataFrame, weights: np.ndarray, terms: list[np.ndarray], n_docs: int, n_terms: int, k: int, doc_tile: int, term_tile: int, item_tile: int) -> DataFrame:
    """(item, score, id) of each task's best ``k`` documents an item."""
    most = max(int(weights.max(initial=1)), 1) * (IMPACT // WEIGHT)
    term_tile = max(1, min(term_tile, (_EXACT - 1) // most))
    item_of = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    term_of = np.concatenate(terms) if len(terms) else np.zeros(0, np.int64)

    def tile_scores(doc, term, impact, n) -> np.ndarray:
        scores = np.zeros((n, len(terms)), np.int64)
        for low in range(0, len(weights), term_tile):
            width = min(term_tile, len(weights) - low)
            here = (term >= low) & (term < low + width)
            if not here.any():
                continue
            impacts = np.zeros((n, width))
            impacts[doc[here], term[here] - low] = impact[here]
            own = (term_of >= low) & (term_of < low + width)
            for first in range(0, len(terms), item_tile):
                some = min(item_tile, len(terms) - first)
                pick = own & (item_of >= first) & (item_of < first + some)
                if pick.any():
                    tile = np.zeros((width, some))
                    tile[term_of[pick] - low, item_of[pick] - first] = weights[term_of[pick]]
                    scores[:, first : first + some] += (impacts @ tile).astype(np.int64)
        return scores

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Best(len(terms), k)
        for whole in batches:
            for start in range(0, whole.num_rows, doc_tile):
                batch = whole.slice(start, doc_tile)
                ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy(zero_copy_only=False)
                n = batch.column("n").to_numpy()
                lists = batch.column("terms")
                sizes = np.diff(lists.offsets.to_numpy())
                term, tf = lists.flatten().to_numpy().astype(np.int64), batch.column("tf").flatten().to_numpy()
                doc = np.repeat(np.arange(len(sizes)), sizes)
                # Python integers where 64 bits would not hold the product.
                wide = n if int(n.max(initial=0)) * LENGTH * n_docs < 2**63 else n.astype(object)
                m = (100 - LENGTH + LENGTH * wide * n_docs // max(n_terms, 1)).astype(np.int64)
                kept.add(tile_scores(doc, term, (IMPACT * tf) // (WEIGHT * tf + DAMP * m[doc]), len(ids)), ids)
        item, score, doc_id = kept.cut()
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(score), pa.array(doc_id, mask=doc_id == _NO_ID)], names=["item", "score", "doc_id"])

    return counts.mapInArrow(best, "item long, score long, doc_id long")


def rank(docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
         most_items: int = 4096, most_pairs: int = 400_000, doc_tile: int = 2048, term_tile: int = 1024, item_tile: int = 256) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the ``k`` best documents of every item, equal scores
    by ascending id (null ids last).

    Null and empty texts have no terms: such a document never appears, such an item has no
    rows.  Repeated documents rank one by one; each row of ``items`` is an item, so repeated
    ones give their rows again.  Empty tables give no rows.  Other columns are ignored.  One
    item's distinct terms fit a task; ids are whole numbers below 2**63 - 1.
    """
    spark, parts = docs.sparkSession, []
    schema = f"{item_col} {items.schema[item_col].dataType.simpleString()}, rank int, {id_col} long, score long"
    for ids, found in _item_blocks(items, item_col, item_text_col, most_items, most_pairs):
        vocabulary = sorted({t for ts in found for t in ts})
        number = {t: i for i, t in enumerate(vocabulary)}
        terms = [np.array(sorted(number[t] for t in ts), np.int64) for ts in found]
        counts = stage(count_terms(docs, vocabulary, id_col, text_col), "search-counts")
        n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        # One row for each term of the block's items, whatever the documents.
        for term, held in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
            df[term] = held
        weights = np.array([math.floor(WEIGHT * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
        hits = _scored(counts, weights, terms, n_docs, n_terms, k, doc_tile, term_tile, item_tile)
        order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
        salted = hits.withColumn("_task", F.spark_partition_id() % 64)
        some = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_task").orderBy(*order))).where(F.col("rank") <= k)
        ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= k)
        named = spark.createDataFrame(list(enumerate(ids)), f"item long, _item {items.schema[item_col].dataType.simpleString()}")
        parts.append(ranked.join(F.broadcast(named), "item").select(F.col("_item").alias(item_col), "rank", F.col("doc_id").alias(id_col), "score"))
    return reduce(DataFrame.unionAll, parts) if parts else spark.createDataFrame([], schema)
