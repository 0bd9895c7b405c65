"""Near-duplicate documents by min-max hashing, with exact confirmation on whole sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelloom.llm.wordsplit import slices
from panelloom.llm.common import stage, unstage

SHINGLE = 5
#: Documents are linked when 100 * |intersection| >= 75 * |union|.
SHARE, OF = 75, 100
#: 64 permutations give 128 signature values (a minimum and a maximum each); 32 bands of 4
#: miss a pair at similarity 0.75 once in 200,000.
PERMUTATIONS, BANDS, BAND_ROWS = 64, 32, 4
#: Members of a bucket that are compared with one another in one task.
BLOCK = 256
_BYTES = 1 << 20  # of text whose shingles are hashed at a time

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype="uint8")
_LOWER[65:91] += 32


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of whole texts: (all hashes, row borders).

    Works on the UTF-8 bytes of all texts at once: words are runs of non-blank bytes, a
    word's hash is a polynomial over its lower-cased bytes, a shingle's hash mixes its
    words' hashes in order.  Hashes have 64 bits.
    """
    raw = [(t or "").encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(raw) + b" ", "uint8")]
    sizes = np.array([len(r) + 1 for r in raw])
    ends = np.cumsum(sizes)
    solid = ~_BLANK[data]
    edge = np.diff(np.concatenate([[False], solid]).astype("int8"))
    first, after = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Polynomial hashes: sum of byte * odd ** (place in word), by Horner's rule over the places.
    length = after - first
    word = np.zeros(len(first), "uint64")
    order = np.argsort(-length, kind="stable")
    begin, size = first[order], length[order]
    running = len(order) - np.searchsorted(size[::-1], np.arange(int(size[0]) if len(size) else 0), side="right")
    acc = np.zeros(len(order), "uint64")
    for place, k in enumerate(running.tolist()):
        acc[:k] = (acc[:k] + data[begin[:k] + place] + np.uint64(1)) * _ODD
    word[order] = _mix(acc)
    doc = np.searchsorted(ends, first, side="right")
    per_doc = np.bincount(doc, minlength=len(raw))
    word_end = np.cumsum(per_doc)
    width = np.minimum(per_doc, SHINGLE)  # shorter texts are one shingle
    count = np.where(per_doc > 0, per_doc - width + 1, 0)
    owner = np.repeat(np.arange(len(raw)), count)
    start = (word_end - per_doc)[owner] + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    span = width[owner]
    h = _mix(span.astype("uint64"))
    for k in range(SHINGLE):
        inside = span > k
        h[inside] = _mix(h[inside] * _ODD + word[start[inside] + k])
    both = np.lexsort((h, owner))
    owner, h = owner[both], h[both]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    borders = np.concatenate([[0], np.cumsum(np.bincount(owner[new], minlength=len(raw)))])
    return h[new], borders


def signatures(hashes: np.ndarray, borders: np.ndarray, seed: int = 29) -> np.ndarray:
    """Min-max signatures: per permutation the least and the greatest permuted hash.

    Both are unbiased samples of the set, from one evaluation per element.  Rows of empty
    sets are zero.
    """
    g = np.random.default_rng(seed)
    a = g.integers(0, 2**63, PERMUTATIONS, dtype="uint64") * np.uint64(2) + np.uint64(1)
    b = g.integers(0, 2**63, PERMUTATIONS, dtype="uint64")
    full = np.flatnonzero(np.diff(borders) > 0)
    out = np.zeros((len(borders) - 1, 2 * PERMUTATIONS), "uint64")
    if len(full):
        at = borders[full]
        for i in range(PERMUTATIONS):
            x = hashes * a[i] + b[i]
            x ^= x >> np.uint64(32)
            x *= a[PERMUTATIONS - 1 - i]
            out[full, 2 * i] = np.minimum.reduceat(x, at)
            out[full, 2 * i + 1] = np.maximum.reduceat(x, at)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number goes into it."""
    keys = np.zeros((len(signature), BANDS), "uint64")
    for band in range(BANDS):
        h = np.full(len(signature), np.uint64(band + 1)) * _ODD
        for r in range(BAND_ROWS):
            # stride: a permutation's minimum and maximum go to different bands
            h = _mix(h * _ODD + signature[:, band + BANDS * r])
        keys[:, band] = h
    return keys.view("int64")


def _set_hash(hashes: np.ndarray) -> bytes:
    """128 bits that tell sets apart: two independent sums over the distinct hashes."""
    return np.array([_mix(hashes * _ODD).sum(), _mix(hashes ^ _ODD).sum()], "uint64").tobytes()


def _sketches(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``set_hash``, ``bands`` and the columns ``carry``."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("n_shingles", T.LongType()),
                           T.StructField("set_hash", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), *[docs.schema[c] for c in carry]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _BYTES):
            hashes, at = shingle_sets(part.column("text").to_pylist())
            keys = band_keys(signatures(hashes, at))
            sets = [_set_hash(hashes[i:j]) for i, j in zip(at[:-1], at[1:])]
            bands = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype="int32") * BANDS), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(sets, pa.binary()), bands, *[part.column(c) for c in carry]], schema.names)

    return docs.select("doc_id", "text", *carry).mapInArrow(run, schema)


def _sets(docs: DataFrame) -> DataFrame:
    """Per row: ``set_hash`` and the whole ``shingles`` (64-bit hashes, ascending)."""
    schema = T.StructType([T.StructField("set_hash", T.BinaryType()), T.StructField("shingles", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text", _BYTES):
            hashes, at = shingle_sets(part.column("text").to_pylist())
            own = [hashes[i:j] for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([pa.array([_set_hash(x) for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], schema.names)

    return docs.select("text").mapInArrow(run, schema)


def _similar(a: bytes, b: bytes) -> bool:
    x, y = np.frombuffer(a, "uint64"), np.frombuffer(b, "uint64")
    small, large = sorted((len(x), len(y)))
    if OF * small < SHARE * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return OF * both >= SHARE * (len(x) + len(y) - both)


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (``a``, ``b``) of set ids whose whole sets are similar enough."""

    @F.pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_similar(a, b) for a, b in zip(x, y)], dtype=bool)

    one = sets.select(F.col("set").alias("a"), F.col("shingles").alias("x"))
    two = sets.select(F.col("set").alias("b"), F.col("shingles").alias("y"))
    return pairs.join(one, "a").join(two, "b").where(similar("x", "y")).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``node``, ``component`` (the least node reachable) of undirected links ``a``, ``b``.

    Large-star and small-star steps in turn: each node's greater neighbours, then its
    smaller ones, are tied to the least node seen.  Every round is written to the shared
    folder; the rounds end when nothing changes.  Hot nodes are aggregated before they
    are shuffled.
    """

    def both(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def tied(e: DataFrame) -> DataFrame:
        least = e.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return e.join(least, "a")

    edges = stage(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        large = tied(both(edges)).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        down = large.where("a > b")
        hubs = tied(down)
        small = hubs.select(F.col("b").alias("a"), F.col("m").alias("b")).union(hubs.select("a", F.col("m").alias("b")))
        after = stage(small.where("a > b").distinct(), "links")
        now = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        unstage(edges)
        edges = after
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        state = now


def _leftover_links(buckets: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside buckets between sets that the first round left apart.

    ``buckets``: ``key``, ``set``, ``label``.  A bucket's largest component needs no
    comparison with itself: its members are compared only with the others.  Members are
    dealt to blocks by hash; a task compares two blocks, by matrix product over the shingles
    that at least two of its members share, and returns a spanning forest of the links.  So
    every pair with different labels is compared, and no pair is emitted but a link.
    """
    size = buckets.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    per = size.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("n_main"), F.count(F.lit(1)).alias("labels"))
    # Copies of a group meet in many bands: buckets with the same members are one.
    members = buckets.groupBy("key").agg(F.sum(F.xxhash64("set").cast("decimal(38,0)")).alias("members"), F.sum(F.xxhash64("set", F.lit(3)).cast("decimal(38,0)")).alias("again"))
    per = per.where("labels > 1 and all > 2").join(members, "key")
    per = per.groupBy("members", "again", "all").agg(F.min_by(F.struct("key", "main", "n_main"), "key").alias("one")).select("one.*", "all")
    rows = buckets.join(per, "key")
    is_main = F.col("label") == F.col("main")
    blocks = lambda n: F.ceil(n / BLOCK).cast("int")
    rows = rows.withColumn("mains", blocks(F.col("n_main"))).withColumn("others", blocks(F.col("all") - F.col("n_main")))
    at = F.pmod(F.xxhash64("set"), F.when(is_main, F.col("mains")).otherwise(F.col("others"))).cast("int")
    # blocks of the others are 0 .. others - 1, those of the largest component follow
    rows = rows.withColumn("block", F.when(is_main, F.col("others") + at).otherwise(at))
    partners = F.when(is_main, F.sequence(F.lit(0), F.col("others") - 1)).otherwise(F.sequence(F.lit(0), F.col("others") + F.col("mains") - 1))
    rows = rows.select("key", "set", "label", "block", F.explode(partners).alias("with"))
    rows = rows.select("key", "set", "label", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"))
    schema = T.StructType([T.StructField("a", sets.schema["set"].dataType), T.StructField("b", sets.schema["set"].dataType)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []

        def groups(last: bool) -> Iterator[pd.DataFrame]:
            if held:
                part = pd.concat(held, ignore_index=True)
                held.clear()
                new = part[["key", "i", "j"]].ne(part[["key", "i", "j"]].shift()).any(axis=1).to_numpy()
                begins = [*np.flatnonzero(new), len(part)]
                if not last:
                    held.append(part.iloc[begins[-2] :])
                    begins.pop()
                found = [x for p, q in zip(begins[:-1], begins[1:]) for x in _forest(part.iloc[p:q])]
                if found:
                    yield pd.DataFrame(found, columns=["a", "b"])

        for frame in frames:
            held.append(frame)
            yield from groups(False)
        yield from groups(True)

    dealt = rows.join(sets, "set").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInPandas(run, schema)


def _forest(group: pd.DataFrame) -> list[tuple]:
    """Links that join the group's labels: similar members of different labels, until no
    further pair of labels can be joined."""
    ids, labels = group["set"].to_list(), group["label"].to_list()
    own = [np.frombuffer(s, "uint64") for s in group["shingles"]]
    sizes = np.array([len(x) for x in own])
    values, column, times = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    shared = times > 1
    place = np.cumsum(shared) - 1
    row = np.repeat(np.arange(len(own)), sizes)
    keep = shared[column]
    common = np.zeros((len(own), len(own)), "float32")
    row, column = row[keep], place[column[keep]]
    for at in range(0, int(shared.sum()), 8192):  # a slice of the shared shingles at a time
        some = (column >= at) & (column < at + 8192)
        there = np.zeros((len(own), 8192), "float32")
        there[row[some], column[some] - at] = 1
        common += there @ there.T
    linked = OF * common >= SHARE * (sizes[:, None] + sizes[None, :] - common)
    root = {x: x for x in labels}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(*np.nonzero(np.triu(linked, 1))):
        p, q = find(labels[x]), find(labels[y])
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((ids[x], ids[y]))
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Group the rows of ``docs`` (``doc_id``, ``text``) by similarity of their five-word shingles.

    Returns one row per input row: ``doc_id``, ``n_shingles``, ``component_id`` (the least
    id reachable over links, itself included), ``kept`` (doc_id = component_id).

    1. One pass hashes every text; rows with equal sets are one node (copies cost one row).
    2. Nodes sharing a band key are candidates.  Each bucket's best-connected node is
       compared with all others, on the whole sets; the confirmed links give components.
    3. In buckets still holding several components, every pair between them is compared, in
       blocks.

    Texts without words are linked with nothing.  A null id is linked with nothing, has a
    null component and is kept.  Rows repeating an id and a text are one node and get equal
    rows; of rows repeating an id with other texts each text is a node, and ids group as the
    texts do.  Other columns are ignored; an empty table gives no rows.
    """
    return grouped(docs).select("doc_id", "n_shingles", "component_id", "kept")


def grouped(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """As :func:`near_duplicates`, with ``component`` (one value per group, which ids that
    stand for several texts do not tell; null for rows linked with nothing) and the columns
    ``carry``."""
    rows = stage(_sketches(docs, carry), "sketches")
    usable = rows.where("doc_id is not null and n_shingles > 0")
    nodes = usable.groupBy("set_hash").agg(F.min("doc_id").alias("set"), F.first("bands").alias("bands"))
    keyed = stage(nodes.select("set_hash", "set", F.explode("bands").alias("key")), "bands")
    often = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = stage(keyed.join(often, "key"), "buckets")
    wanted = buckets.select("set_hash", "set").distinct()
    # The candidates grow with the corpus, so this join is planned alike at every size.
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("set").alias("doc_id")).distinct().hint("shuffle_merge"), "doc_id", "left_semi")
    sets = stage(_sets(texts).dropDuplicates(["set_hash"]).join(wanted, "set_hash").select(F.col("set_hash").alias("set"), "shingles"), "sets")
    buckets = buckets.select("key", F.col("set_hash").alias("set"), "n")

    degree = buckets.groupBy("set").agg(F.sum("n").alias("degree"))
    ranked = buckets.join(degree, "set")
    centre = ranked.groupBy("key").agg(F.max_by("set", F.struct("degree", "set")).alias("a"))
    star = buckets.join(centre, "key").where("a != set").select("a", F.col("set").alias("b"))
    star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stage(confirm(star, sets), "star-links")
    first = components(links)
    labelled = buckets.select("key", "set").join(first, F.col("set") == F.col("node"), "left")
    labelled = labelled.select("key", "set", F.coalesce("component", "set").alias("label"))
    more = stage(_leftover_links(labelled, sets), "block-links")
    joined = components(links.select("a", "b").union(more.select("a", "b")))

    classes = usable.groupBy("set_hash").agg(F.min("doc_id").alias("least"))
    classes = classes.join(joined, F.col("set_hash") == F.col("node"), "left").select("set_hash", "least", F.coalesce("component", "set_hash").alias("component"))
    lowest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    found = classes.join(lowest, "component").select("set_hash", "component_id", "component")
    out = rows.select("doc_id", "n_shingles", *carry, F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("set_hash")).alias("set_hash"))
    out = out.join(found, "set_hash", "left")
    least = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", least.alias("component_id"), F.col("doc_id").eqNullSafe(least).alias("kept"), "component", *carry)
